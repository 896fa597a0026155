"""All registered ledger queries and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, text
from ..operators import classify, cluster, coverage, identity, ledgerqa, maintenance, merchants, overview, proposals, recurring, reports
from ..sources import documents, statements
from . import testledger as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MONTH, HOLDER, TODAY = "1996-03", "Holder 1", date(2000, 12, 31)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that follows the ledger's common table expressions."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = t.LEDGER_CTE + sql
        return f

    return keep



def _with(df: DataFrame, *names: str) -> DataFrame:
    """Money columns as rounded doubles, counts as they are."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), 2) for n in names})


# --- identity ---------------------------------------------------------------------------------------------------------


@query("SELECT txn_id, card, posted_date, CAST(amount AS DOUBLE) AS amount, raw_description, normalized_merchant, source_document_id, CAST(source_occurrence AS BIGINT) AS source_occurrence FROM ledger")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identity.normalize(t.raw(spark, sf_dir))
    return rows.select("txn_id", "card", "posted_date", F.col("amount").cast("double").alias("amount"), "raw_description", "normalized_merchant", "source_document_id", "source_occurrence")


@query("SELECT DISTINCT substring(sha256(card || '|' || CAST(posted_date AS VARCHAR) || '|' || CAST(amount AS VARCHAR) || '|' || trim(raw_description) || '|' || CAST(source_occurrence AS VARCHAR)), 1, 16) AS txn_id, source_document_id, source_row, CAST(source_occurrence AS BIGINT) AS source_occurrence FROM occ")
def transaction_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.transaction_sources(t.raw(spark, sf_dir)).drop("source_file")


@query("SELECT source_document_id, source_row, CAST(source_occurrence AS BIGINT) AS source_occurrence FROM occ")
def source_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.source_occurrence(t.raw(spark, sf_dir)).select("source_document_id", "source_row", "source_occurrence")


@query(
    r""", k AS (SELECT DISTINCT normalized_merchant FROM ledger), s AS (SELECT normalized_merchant, trim(regexp_replace(trim(regexp_replace(normalized_merchant,
    '^(?:APLPAY|APPLE\s+PAY|GPPAY|GOOGLE\s+PAY|PAYPAL|PP|SQ|TST|SP)\b[\s\-*]*', '')), '^(?:APLPAY|APPLE\s+PAY|GPPAY|GOOGLE\s+PAY|PAYPAL|PP|SQ|TST|SP)\b[\s\-*]*', '')) AS c FROM k),
    w AS (SELECT normalized_merchant, list_filter(string_split(c, ' '), lambda x: x <> '') AS w FROM s),
    """
    + f"""d AS (SELECT normalized_merchant, CASE WHEN list_contains({list(identity.STATES)}, w[-1]) THEN list_slice(w, 1, greatest(len(w) - 2, 0)) ELSE w END AS w FROM w)
    SELECT normalized_merchant, CASE WHEN len(w) = 0 THEN normalized_merchant ELSE array_to_string(w, ' ') END AS identity_key FROM d"""
)
def merchant_identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = identity.normalize(t.raw(spark, sf_dir)).select("normalized_merchant").distinct()
    return names.withColumn("identity_key", identity.merchant_identity_key("normalized_merchant"))


@query("SELECT CAST(count(*) AS BIGINT) AS ledger_rows, CAST(count(*) FILTER (posted_date >= DATE '1998-01-01') AS BIGINT) AS new_rows FROM ledger")
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger up to 1997, to which everything comes again."""
    everything = identity.normalize(t.raw(spark, sf_dir))
    old = everything.where("posted_date < date'1998-01-01'")
    whole, fresh = maintenance.append_new(old, everything, t.aliases(spark))
    return whole.agg(F.count("*").alias("ledger_rows")).crossJoin(fresh.agg(F.count("*").alias("new_rows")))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT txn_id) AS BIGINT) AS ids, CAST(0 AS BIGINT) AS changed FROM ledger")
def migrate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identity.normalize(t.raw(spark, sf_dir))
    again = maintenance.migrate_ids(rows.withColumn("txn_id", F.concat(F.lit("old"), "txn_id")).drop("proposed_canonical"))
    known = rows.select("txn_id", F.lit(1).alias("same"))
    return again.join(known, "txn_id", "left").agg(F.count("*").alias("rows"), F.count_distinct("txn_id").alias("ids"), F.count_if(F.col("same").isNull()).alias("changed"))


# --- merchants and classification -------------------------------------------------------------------------------------


@query("SELECT txn_id, canonical_merchant, merchant_source FROM ledger")
def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merchants.canonicalize(identity.normalize(t.raw(spark, sf_dir)), t.aliases(spark)).select("txn_id", "canonical_merchant", "merchant_source")


@query("SELECT canonical, category, coalesce(subcategory, '') AS subcategory FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY entry_idx DESC) AS n FROM aliases WHERE category IS NOT NULL) WHERE n = 1")
def merchant_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults of merchants that occur."""
    used = t.ledger(spark, sf_dir).select(F.col("canonical_merchant").alias("canonical")).distinct()
    return merchants.merchant_defaults(t.aliases(spark)).join(used, "canonical", "left_semi")


@query("SELECT a.canonical, CAST(1 AS BIGINT) AS alias_count, CAST(count(l.txn_id) AS BIGINT) AS txn_count, round(CAST(coalesce(sum(l.amount), 0) AS DOUBLE), 2) AS total_amount FROM aliases a LEFT JOIN ledger l ON l.canonical_merchant = a.canonical GROUP BY 1")
def merchant_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(merchants.merchant_usage(t.ledger(spark, sf_dir), t.aliases(spark)), "total_amount")


@query("SELECT CAST(count(canonical_merchant) AS BIGINT) AS resolved FROM ledger")
def recanonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merchants.recanonicalize(t.ledger(spark, sf_dir), t.aliases(spark))[1]


@query("SELECT txn_id, CASE WHEN normalized_merchant = 'APLPAY ORCA SEATTLE WA' THEN 'Orca' ELSE canonical_merchant END AS canonical_merchant, CASE WHEN normalized_merchant = 'APLPAY ORCA SEATTLE WA' THEN 'manual' ELSE merchant_source END AS merchant_source FROM ledger")
def stamp_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.createDataFrame([("APLPAY ORCA SEATTLE WA",)], "normalized_merchant string")
    return merchants.stamp_canonical(t.ledger(spark, sf_dir), members, "Orca").select("txn_id", "canonical_merchant", "merchant_source")


@query("SELECT txn_id, category0 AS category, subcategory, by0 AS classified_by FROM classed")
def classify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.classify_ledger(identity.normalize(t.raw(spark, sf_dir)), t.aliases(spark), t.rules(spark))
    return rows.select("txn_id", "category", "subcategory", "classified_by")


@query("SELECT CAST(count(*) FILTER (classified_by = 'rule') AS BIGINT) AS rule, CAST(count(*) FILTER (classified_by = 'merchant') AS BIGINT) AS merchant, CAST(count(*) FILTER (classified_by = 'ai') AS BIGINT) AS ai, CAST(count(*) FILTER (classified_by = 'manual') AS BIGINT) AS manual, CAST(count(*) FILTER (coalesce(classified_by, '') = '') AS BIGINT) AS open, CAST(count(*) AS BIGINT) AS total FROM ledger")
def classification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classification_counts(t.ledger(spark, sf_dir))


_REVIEW = "(coalesce(classified_by, '') NOT IN ('manual', 'rule', 'merchant') AND (classified_by = 'ai' OR coalesce(category, '') IN ('', 'Uncategorized')))"


@query(f"SELECT txn_id, coalesce({_REVIEW}, false) AS needs_review, (coalesce(classified_by, '') NOT IN ('manual', 'rule', 'merchant') OR coalesce(category, '') IN ('', 'Uncategorized')) AS is_open, (coalesce(classified_by, '') NOT IN ('manual', 'rule', 'merchant') AND coalesce(category, '') IN ('', 'Uncategorized')) AS needs_suggestion FROM ledger")
def review_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.ledger(spark, sf_dir).select("txn_id", classify.needs_review().alias("needs_review"), classify.is_open().alias("is_open"), classify.needs_suggestion().alias("needs_suggestion"))


@query(f", r AS (SELECT * FROM ledger WHERE {_REVIEW}) SELECT txn_id, CAST(amount AS DOUBLE) AS amount, (SELECT CAST(count(*) AS BIGINT) FROM r) AS queue_total FROM r ORDER BY r.amount DESC, txn_id LIMIT 100")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.review_queue(t.ledger(spark, sf_dir)).select("txn_id", F.col("amount").cast("double").alias("amount"), "queue_total")


@query(f"SELECT txn_id, 'Shopping' AS category, 'Retail' AS subcategory FROM ledger WHERE {_REVIEW} AND (regexp_matches(normalized_merchant, '(?i)loc 1') OR regexp_matches(raw_description, '(?i)loc 1'))")
def apply_rule_to_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"kind": "regex", "pattern": "(?i)loc 1", "category": "Shopping", "subcategory": "Retail"}
    return classify.apply_rule_to_open(t.ledger(spark, sf_dir), rule).where("changed").select("txn_id", "category", "subcategory")


@query("SELECT txn_id, CASE WHEN txn_id[1] = '7' THEN 'Travel' ELSE category END AS category, CASE WHEN txn_id[1] = '7' THEN 'manual' ELSE classified_by END AS classified_by FROM ledger")
def apply_review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.ledger(spark, sf_dir)
    decisions = rows.where("txn_id like '7%'").select("txn_id", F.lit("Travel").alias("category"), F.lit(None).cast("string").alias("subcategory"), F.lit(None).cast("array<string>").alias("tags"))
    return classify.apply_review_decisions(rows, decisions)[0].select("txn_id", "category", "classified_by")


@query("SELECT id, id IN (SELECT unnest(tags) FROM ledger) AS in_use FROM tagnames")
def tags_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.tags_in_use(t.ledger(spark, sf_dir), t.tags(spark))


@query(r"SELECT DISTINCT card_issuer, trim(regexp_replace(lower(card_issuer), '[^a-z0-9]+', '-', 'g'), '-') AS slug, array_to_string(list_filter(list_transform(regexp_split_to_array(card_issuer || ', a |' || card_issuer, '[,|]'), lambda x: trim(x)), lambda x: x <> ''), ';') AS tags FROM ledger")
def tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.ledger(spark, sf_dir).select("card_issuer").distinct()
    return rows.select("card_issuer", classify.tag_slug("card_issuer").alias("slug"), F.array_join(classify.split_tags(F.concat("card_issuer", F.lit(", a |"), "card_issuer")), ";").alias("tags"))


# --- reports ----------------------------------------------------------------------------------------------------------

_SUM = "round(CAST(sum(amount) AS DOUBLE), 2) AS total, CAST(count(*) AS BIGINT) AS txn_count"


@query(f"SELECT month, coalesce(category, 'Uncategorized') AS category, coalesce(subcategory, '') AS subcategory, {_SUM} FROM ledger WHERE amount > 0 GROUP BY ALL")
def category_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(reports.category_monthly(t.ledger(spark, sf_dir)), "total")


@query(f"SELECT month, coalesce(category, 'Uncategorized') AS category, {_SUM} FROM ledger WHERE amount > 0 GROUP BY ALL")
def category_monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(reports.category_monthly_totals(t.ledger(spark, sf_dir)), "total")


@query(f"SELECT month, coalesce(canonical_merchant, normalized_merchant) AS merchant, canonical_merchant IS NOT NULL AS is_canonical, {_SUM} FROM ledger WHERE amount > 0 GROUP BY ALL")
def merchant_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(reports.merchant_monthly(t.ledger(spark, sf_dir)), "total")


@query(f"SELECT coalesce(canonical_merchant, normalized_merchant) AS merchant, canonical_merchant IS NOT NULL AS is_canonical, {_SUM} FROM ledger WHERE amount > 0 GROUP BY ALL")
def merchant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(reports.merchant_totals(t.ledger(spark, sf_dir)), "total")


@query(f"SELECT coalesce(category, 'Uncategorized') AS category, {_SUM} FROM ledger WHERE amount > 0 GROUP BY ALL")
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(reports.category_totals(t.ledger(spark, sf_dir)), "total")


@query(", c AS (SELECT coalesce(category, 'Uncategorized') AS category, month, amount FROM ledger WHERE amount > 0), top AS (SELECT category FROM c GROUP BY 1 ORDER BY sum(amount) DESC, 1 LIMIT 1) SELECT month, category, round(CAST(sum(amount) AS DOUBLE), 2) AS total FROM c JOIN top USING (category) GROUP BY ALL")
def category_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(reports.category_trend(t.ledger(spark, sf_dir)), "total")


_RECURRING = """, spend AS (SELECT *, CAST(amount AS DOUBLE) AS a FROM ledger WHERE amount > 0),
gaps AS (SELECT normalized_merchant, date_diff('day', lag(posted_date) OVER (PARTITION BY normalized_merchant ORDER BY posted_date), posted_date) AS g FROM spend),
med AS (SELECT normalized_merchant, median(g) AS gap FROM gaps GROUP BY 1),
st AS (SELECT normalized_merchant, count(*) AS n, CAST(sum(amount) AS DOUBLE) / count(*) AS av, stddev_pop(a) AS sd FROM spend GROUP BY 1),
cat AS (SELECT normalized_merchant, category, row_number() OVER (PARTITION BY normalized_merchant ORDER BY count(*) DESC, category) AS k FROM spend WHERE category IS NOT NULL GROUP BY 1, 2),
rec AS (SELECT normalized_merchant, n AS occurrences, av, sd, gap, (sd / av < 0.25 AND (coalesce(gap BETWEEN 25 AND 40, false) OR n >= 3)) AS is_recurring, category
        FROM st LEFT JOIN med USING (normalized_merchant) LEFT JOIN (SELECT * FROM cat WHERE k = 1) USING (normalized_merchant) WHERE n >= 2)
"""


@query(_RECURRING + "SELECT normalized_merchant, CAST(occurrences AS BIGINT) AS occurrences, round(gap, 1) AS median_gap_days, is_recurring, category FROM rec")
def recurring_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recurring.recurring(t.ledger(spark, sf_dir))
    return found.select("normalized_merchant", "occurrences", "median_gap_days", "is_recurring", "category")


@query(_RECURRING + "SELECT normalized_merchant FROM rec WHERE is_recurring")
def recurring_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring.recurring_only(recurring.recurring(t.ledger(spark, sf_dir))).select("normalized_merchant")


@query(_RECURRING + "SELECT CAST(count(*) AS BIGINT) AS txn_count, CAST(count(*) FILTER (classified_by IS NULL OR category IS NULL OR category = 'Uncategorized' OR classified_by = 'ai') AS BIGINT) AS uncategorized_count, CAST(count(canonical_merchant) AS BIGINT) AS canonical_count, CAST(count(DISTINCT normalized_merchant) FILTER (canonical_merchant IS NULL) AS BIGINT) AS unknown_merchant_count, (SELECT CAST(count(*) AS BIGINT) FROM rec WHERE is_recurring) AS recurring_count FROM ledger")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.ledger(spark, sf_dir)
    return reports.ledger_summary(rows, recurring.recurring(rows))


@query(f"SELECT CAST(count(canonical_merchant) AS BIGINT) AS canonical, CAST(count(DISTINCT normalized_merchant) FILTER (canonical_merchant IS NULL) AS BIGINT) AS unknown_merchants, CAST(count(*) FILTER ({_REVIEW}) AS BIGINT) AS review_pending, CAST(count(DISTINCT cardholder) AS BIGINT) AS cardholders FROM ledger")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(t.ledger(spark, sf_dir)).select("canonical", "unknown_merchants", "review_pending", "cardholders")


@query("SELECT DISTINCT cardholder FROM ledger WHERE cardholder IS NOT NULL")
def cardholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cardholders(t.ledger(spark, sf_dir))


@query("SELECT DISTINCT 'card' AS facet, card AS value FROM ledger UNION SELECT DISTINCT 'category', coalesce(category, 'Uncategorized') FROM ledger")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.facets(t.ledger(spark, sf_dir))


@query("SELECT txn_id FROM ledger WHERE classified_by IS NULL OR category IS NULL OR category = 'Uncategorized' OR classified_by = 'ai'")
def export_uncategorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.publish_ledger(reports.export_uncategorized(t.ledger(spark, sf_dir))).select("txn_id")


@query(_RECURRING + "SELECT 'Recurring merchant' AS normalized_merchant, CAST(count(*) AS BIGINT) AS rows FROM rec")
def redact_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.redact_recurring(recurring.recurring(t.ledger(spark, sf_dir))).groupBy("normalized_merchant").agg(F.count("*").alias("rows"))


_BILLS = """, hits AS (SELECT b.bill_idx, l.* FROM ledger l JOIN bills b ON b.merchant_regex IS NOT NULL AND (regexp_matches(normalized_merchant, merchant_regex) OR regexp_matches(raw_description, merchant_regex)) WHERE amount > 0),
names AS (SELECT bill_idx, normalized_merchant, row_number() OVER (PARTITION BY bill_idx ORDER BY count(*) DESC, normalized_merchant) AS k FROM hits GROUP BY 1, 2),
seen AS (SELECT bill_idx, CAST(sum(amount) AS DOUBLE) / count(*) AS av, max(posted_date) AS last FROM hits GROUP BY 1),
recon AS (SELECT b.bill_idx, b.name AS bill, CASE WHEN av IS NULL THEN 'missing' WHEN expected_amount IS NOT NULL AND abs(av - expected_amount) > greatest(5.0, 0.1 * expected_amount) THEN 'amount_mismatch' ELSE 'matched' END AS status,
  n.normalized_merchant AS matched_merchant, round(av, 2) AS matched_avg, strftime(last, '%Y-%m-%d') AS last_seen FROM bills b LEFT JOIN seen USING (bill_idx) LEFT JOIN (SELECT * FROM names WHERE k = 1) n USING (bill_idx))
"""


@query(_BILLS + "SELECT bill, status, matched_merchant, matched_avg, last_seen FROM recon")
def reconcile_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring.reconcile_bills(t.ledger(spark, sf_dir), t.bills(spark)).select("bill", "status", "matched_merchant", "matched_avg", "last_seen")


@query(_BILLS + "SELECT 'Expected bill' AS bill, status, CAST(NULL AS VARCHAR) AS matched_merchant FROM recon")
def redact_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.redact_reconciliation(recurring.reconcile_bills(t.ledger(spark, sf_dir), t.bills(spark))).select("bill", "status", "matched_merchant")


# --- overview and coverage --------------------------------------------------------------------------------------------

_MONTHS = """, parts AS (SELECT month, 'household' AS scope, NULL AS cardholder, * EXCLUDE (month, cardholder) FROM ledger UNION ALL BY NAME SELECT month, 'holder' AS scope, cardholder, * EXCLUDE (month, cardholder) FROM ledger WHERE cardholder IS NOT NULL),
agg AS (SELECT month, scope, cardholder, coalesce(CAST(sum(amount) FILTER (amount > 0) AS DOUBLE), 0) AS spend, count(*) FILTER (amount > 0) AS n, coalesce(CAST(sum(amount) FILTER (amount < 0) AS DOUBLE), 0) AS paid,
  coalesce(CAST(sum(amount) FILTER (amount > 0 AND coalesce(category, '') IN ('', 'Uncategorized')) AS DOUBLE), 0) AS ot, count(*) FILTER (amount > 0 AND coalesce(category, '') IN ('', 'Uncategorized')) AS oc FROM parts GROUP BY ALL),
ms AS (SELECT a.month, a.scope, a.cardholder, a.spend, a.n, a.paid, a.ot, a.oc, coalesce(b.spend, 0) AS prior, a.month > (SELECT min(month) FROM ledger) AS has
  FROM agg a LEFT JOIN agg b ON strftime(CAST(b.month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') = a.month AND a.scope = b.scope AND a.cardholder IS NOT DISTINCT FROM b.cardholder)
"""
_MONTH_COLUMNS = "month, scope, cardholder, round(spend, 2) AS spend_total, CASE WHEN has THEN round(prior, 2) END AS prior_spend_total, CASE WHEN has THEN round(spend - prior, 2) END AS spend_delta, CAST(n AS BIGINT) AS charge_count, round(abs(paid), 2) AS payments_and_refunds, round(ot, 2) AS uncategorized_total, CAST(oc AS BIGINT) AS uncategorized_count"
_MONTH_NAMES = ("month", "scope", "cardholder", "spend_total", "prior_spend_total", "spend_delta", "charge_count", "payments_and_refunds", "uncategorized_total", "uncategorized_count")


@query(_MONTHS + f"SELECT {_MONTH_COLUMNS} FROM ms")
def month_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.month_summaries(t.ledger(spark, sf_dir)).select(*_MONTH_NAMES)


@query(_MONTHS + f"SELECT {_MONTH_COLUMNS} FROM ms WHERE month = '{MONTH}' AND cardholder = '{HOLDER}'")
def month_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.month_summary(t.ledger(spark, sf_dir), MONTH, HOLDER).select(*_MONTH_NAMES)


_DELTAS = ", c AS (SELECT coalesce(category, 'Uncategorized') AS category, coalesce(CAST(sum(amount) FILTER (month = '1996-03') AS DOUBLE), 0) AS now, coalesce(CAST(sum(amount) FILTER (month = '1996-02') AS DOUBLE), 0) AS prior FROM ledger WHERE amount > 0 AND month IN ('1996-02', '1996-03') GROUP BY 1) "


@query(_DELTAS + "SELECT category, round(now, 2) AS total, round(prior, 2) AS prior_total, round(now - prior, 2) AS delta FROM c")
def month_category_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.month_category_deltas(t.ledger(spark, sf_dir), MONTH)


@query(_DELTAS + "SELECT category, round(now - prior, 2) AS delta FROM c WHERE now <> prior ORDER BY abs(now - prior) DESC, category LIMIT 6")
def month_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.month_movers(overview.month_category_deltas(t.ledger(spark, sf_dir), MONTH)).select("category", "delta")


@query(f"SELECT coalesce(cardholder, 'Unassigned') AS name, round(CAST(sum(amount) AS DOUBLE), 2) AS total FROM ledger WHERE amount > 0 AND month = '{MONTH}' GROUP BY 1")
def month_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(overview.month_holders(t.ledger(spark, sf_dir), MONTH), "total")


@query(f"SELECT txn_id, coalesce(canonical_merchant, normalized_merchant) AS merchant, CAST(amount AS DOUBLE) AS amount, category, cardholder FROM ledger WHERE amount >= 200 AND month = '{MONTH}' ORDER BY ledger.amount DESC, txn_id LIMIT 10")
def large_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(overview.large_charges(t.ledger(spark, sf_dir), MONTH).drop("posted_date"), "amount")


@query("SELECT month, CAST(k AS INTEGER) AS place, txn_id, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY amount DESC, txn_id) AS k FROM ledger WHERE amount >= 200) WHERE k <= 10")
def large_charges_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(overview.large_charges_by_month(t.ledger(spark, sf_dir)).drop("merchant"), "amount")


@query(f"SELECT id, label, kind, round(CAST(sum(amount) AS DOUBLE), 2) AS total FROM (SELECT amount, unnest(tags) AS id FROM ledger WHERE amount > 0 AND month = '{MONTH}') JOIN tagnames USING (id) WHERE kind IN ('trip', 'occasion') GROUP BY ALL")
def tag_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(overview.tag_spend(t.ledger(spark, sf_dir), t.tags(spark), MONTH), "total")


@query(_BILLS + f"SELECT b.name AS bill, CASE WHEN b.bill_idx IN (SELECT bill_idx FROM hits WHERE month = '{MONTH}') THEN 'seen' ELSE 'missing' END AS status FROM bills b")
def bills_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.bills_seen(t.ledger(spark, sf_dir), t.bills(spark), MONTH).select("bill", "status")


@query("SELECT DISTINCT month FROM ledger")
def available_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.available_months(t.ledger(spark, sf_dir))


_STATEMENTS = """, st AS (SELECT card_issuer AS issuer, coalesce(card_product, 'Unassigned') AS product, coalesce(cardholder, 'Unassigned') AS holder, source_document_id AS document, count(*) AS n, count(*) FILTER (amount > 0) AS charges,
  coalesce(CAST(sum(amount) FILTER (amount > 0) AS DOUBLE), 0) AS spend, abs(coalesce(CAST(sum(amount) FILTER (amount < 0) AS DOUBLE), 0)) AS paid, min(posted_date) AS s, max(posted_date) AS e FROM ledger GROUP BY ALL),
gap AS (SELECT issuer, product, holder, after, s AS before, date_diff('day', after, s) AS days FROM (SELECT *, lag(e) OVER (PARTITION BY issuer, product, holder ORDER BY s, e, document) AS after FROM st) WHERE date_diff('day', after, s) > 14)
"""


@query(_STATEMENTS + "SELECT issuer, product, holder, document, CAST(n AS BIGINT) AS txn_count, CAST(charges AS BIGINT) AS charge_count, round(spend, 2) AS spend_total, round(paid, 2) AS payments_and_refunds, s AS coverage_start, e AS coverage_end FROM st")
def statement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.statement_stats(t.ledger(spark, sf_dir))
    return _with(found, "spend_total", "payments_and_refunds").drop("file_name", "uncategorized_count", "uncategorized_total")


@query(_STATEMENTS + "SELECT issuer, product, holder, after, before, CAST(days AS INTEGER) AS days FROM gap")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_gaps(coverage.statement_stats(t.ledger(spark, sf_dir)))


_COVERAGE = (
    _STATEMENTS
    + """, tot AS (SELECT issuer, product, holder, count(*) AS statements, max(e) AS last FROM st GROUP BY ALL), g AS (SELECT issuer, product, holder, count(*) AS gaps FROM gap GROUP BY ALL),
cov AS (SELECT issuer, product, holder, CAST(statements AS BIGINT) AS statement_count, CASE WHEN gaps > 0 THEN 'gap' WHEN date_diff('day', last, DATE '2000-12-31') > 40 THEN 'stale' ELSE 'ok' END AS status,
  CASE WHEN date_diff('day', last, DATE '2000-12-31') > 40 THEN CAST(date_diff('day', last, DATE '2000-12-31') AS INTEGER) END AS stale_days, CAST(coalesce(gaps, 0) AS INTEGER) AS gap_count FROM tot LEFT JOIN g USING (issuer, product, holder)
 UNION ALL SELECT issuer, product, '', 0, 'none', NULL, 0 FROM products WHERE (issuer, product) NOT IN (SELECT (issuer, product) FROM st)) """
)


@query(_COVERAGE + "SELECT * FROM cov")
def cards_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.cards_coverage(t.ledger(spark, sf_dir), t.products(spark), TODAY)
    return found.select("issuer", "product", "holder", "statement_count", "status", "stale_days", F.coalesce(F.size("gaps"), F.lit(0)).alias("gap_count"))


@query(_STATEMENTS + "SELECT issuer, product, holder, s AS coverage_start, document AS id, document || '.csv' AS file_name, CAST(n AS BIGINT) AS txn_count, round(spend, 2) AS spend_total, round(paid, 2) AS payments_and_refunds, e AS coverage_end, CAST(row_number() OVER (PARTITION BY issuer, product, holder ORDER BY s, document) AS INTEGER) AS place FROM st")
def coverage_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements that each product and holder lists, in their order."""
    found = coverage.cards_coverage(t.ledger(spark, sf_dir), t.products(spark), TODAY)
    each = found.select("issuer", "product", "holder", F.posexplode("statements").alias("place", "s"))
    return _with(each.select("issuer", "product", "holder", "s.*", (F.col("place") + 1).alias("place")), "spend_total", "payments_and_refunds")


@query(_STATEMENTS + "SELECT issuer, product, holder, after, before, CAST(days AS INTEGER) AS days, CAST(row_number() OVER (PARTITION BY issuer, product, holder ORDER BY after, before) AS INTEGER) AS place FROM gap")
def coverage_gap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps that each product and holder lists, in their order."""
    found = coverage.cards_coverage(t.ledger(spark, sf_dir), t.products(spark), TODAY)
    each = found.select("issuer", "product", "holder", F.posexplode("gaps").alias("place", "g"))
    return each.select("issuer", "product", "holder", "g.*", (F.col("place") + 1).alias("place"))


@query(_COVERAGE + "SELECT issuer, product, holder, status FROM cov WHERE issuer = 'BUILDING' AND product = 'Product 0' ORDER BY issuer, product, holder LIMIT 1")
def select_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.cards_coverage(t.ledger(spark, sf_dir), t.products(spark), TODAY)
    return coverage.select_product(found, "BUILDING", "Product 0").select("issuer", "product", "holder", "status")


# --- questions --------------------------------------------------------------------------------------------------------


@query("SELECT txn_id, posted_date FROM ledger WHERE contains(lower(raw_description || ' ' || normalized_merchant || ' ' || coalesce(canonical_merchant, '')), 'shell') AND category = 'Transport' AND card = 'card-3' ORDER BY ledger.posted_date DESC, txn_id LIMIT 200 OFFSET 5")
def search_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgerqa.search_ledger(t.ledger(spark, sf_dir), q="SHELL", category="Transport", card="card-3", offset=5)[0].select("txn_id", "posted_date")


@query("SELECT posted_date, CAST(amount AS DOUBLE) AS amount, canonical_merchant, normalized_merchant, category, card, cardholder FROM ledger WHERE posted_date BETWEEN DATE '1996-01-05' AND DATE '1996-03-20' AND cardholder = 'Holder 1'")
def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = ledgerqa.window_filter(ledgerqa.project_ledger_view(t.ledger(spark, sf_dir)), "1996-01-05", "1996-03-20", HOLDER)
    return _with(view, "amount").drop("card_issuer", "card_product", "tags")


@query("SELECT CAST(count(*) AS BIGINT) AS txn_count, min(posted_date) AS first_posted, max(posted_date) AS last_posted, string_agg(DISTINCT cardholder, ',' ORDER BY cardholder) AS cardholders FROM ledger")
def ledger_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgerqa.ledger_snapshot(ledgerqa.project_ledger_view(t.ledger(spark, sf_dir)))


@query("SELECT card_issuer, card_product, cardholder, max(posted_date) AS last_posted, CAST(count(*) AS BIGINT) AS txn_count FROM ledger GROUP BY ALL")
def snapshot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgerqa.snapshot_products(ledgerqa.project_ledger_view(t.ledger(spark, sf_dir)))


_NET = "round(coalesce(CAST(sum(amount) FILTER (amount > 0) AS DOUBLE), 0), 2) AS gross_charges, round(abs(coalesce(CAST(sum(amount) FILTER (amount < 0) AS DOUBLE), 0)), 2) AS credits_refunds, round(coalesce(CAST(sum(amount) AS DOUBLE), 0), 2) AS net_spend, CAST(count(*) FILTER (amount > 0) AS BIGINT) AS charge_count, CAST(count(*) FILTER (amount < 0) AS BIGINT) AS credit_count, min(posted_date) AS first_posted, max(posted_date) AS last_posted"


@query(f"SELECT {_NET}, count(DISTINCT coalesce(canonical_merchant, normalized_merchant)) > 1 AS ambiguous FROM ledger WHERE posted_date >= DATE '1996-01-01' AND (contains(lower(coalesce(canonical_merchant, '')), 'uber') OR contains(lower(normalized_merchant), 'uber'))")
def merchant_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgerqa.merchant_spend(ledgerqa.project_ledger_view(t.ledger(spark, sf_dir)), "Uber", since="1996-01-01")


@query(", m AS (SELECT coalesce(canonical_merchant, normalized_merchant) AS name, round(coalesce(CAST(sum(amount) FILTER (amount > 0) AS DOUBLE), 0), 2) AS g, round(CAST(sum(amount) AS DOUBLE), 2) AS net_spend, count(*) FILTER (amount > 0) AS n FROM ledger WHERE contains(lower(coalesce(canonical_merchant, '')), 'al') OR contains(lower(normalized_merchant), 'al') GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY g DESC, name) AS k FROM m) SELECT name, g AS gross_charges, net_spend, CAST(n AS BIGINT) AS charge_count FROM r WHERE k <= 12 UNION ALL SELECT '+' || CAST(count(*) - 12 AS VARCHAR) || ' more', 0.0, 0.0, 0 FROM r HAVING count(*) > 12")
def matched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgerqa.matched_names(ledgerqa.project_ledger_view(t.ledger(spark, sf_dir)), "al").drop("place")


@query(f"SELECT {_NET} FROM ledger WHERE lower(category) = 'food'")
def category_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgerqa.category_spend(ledgerqa.project_ledger_view(t.ledger(spark, sf_dir)), "food")


@query(f"SELECT {_NET} FROM ledger WHERE contains(lower(category), 'rans')")
def category_spend_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgerqa.category_spend(ledgerqa.project_ledger_view(t.ledger(spark, sf_dir)), "rans")


@query("SELECT CAST(count(*) AS BIGINT) AS match_count, CAST(count(*) FILTER (amount > 0) AS BIGINT) AS charge_count, round(CAST(sum(amount) FILTER (amount > 0) AS DOUBLE), 2) AS gross_charges FROM ledger WHERE category = 'Shopping' AND contains(lower(coalesce(canonical_merchant, '') || '|' || normalized_merchant), 'wal')")
def search_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgerqa.search_transactions(ledgerqa.project_ledger_view(t.ledger(spark, sf_dir)), "wal", "Shopping")[0].select("match_count", "charge_count", "gross_charges")


@query("SELECT CAST(amount AS DOUBLE) AS amount FROM ledger WHERE category = 'Shopping' AND contains(lower(coalesce(canonical_merchant, '') || '|' || normalized_merchant), 'wal') AND amount > 0 ORDER BY ledger.amount DESC LIMIT 15")
def search_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(ledgerqa.search_transactions(ledgerqa.project_ledger_view(t.ledger(spark, sf_dir)), "wal", "Shopping")[1].select("amount"), "amount")


@query("SELECT '1996-01-01' AS since, strftime(max(posted_date), '%Y-%m-%d') AS until, strftime(min(posted_date), '%Y-%m-%d') AS first_posted, strftime(max(posted_date), '%Y-%m-%d') AS last_posted FROM ledger")
def period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgerqa.period(t.ledger(spark, sf_dir), since="1996-01-01")


@query(_DELTAS + "SELECT category, round(now, 2) AS total, round(prior, 2) AS prior_total, round(now - prior, 2) AS delta FROM c")
def month_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.month_facts(ledgerqa.project_ledger_view(t.ledger(spark, sf_dir)), t.bills(spark), MONTH)["categories"]


@query(_DELTAS + _MONTHS + _BILLS + f""", facts AS (
SELECT 'category' AS part, category AS name, round(now, 2) AS value, round(now - prior, 2) AS more FROM c
UNION ALL (SELECT 'mover', category, round(now, 2), round(now - prior, 2) FROM c WHERE now <> prior ORDER BY abs(now - prior) DESC, category LIMIT 6)
UNION ALL SELECT 'holder', coalesce(cardholder, 'Unassigned'), round(CAST(sum(amount) AS DOUBLE), 2), NULL FROM ledger WHERE amount > 0 AND month = '{MONTH}' GROUP BY 2
UNION ALL (SELECT 'charge', coalesce(canonical_merchant, normalized_merchant), CAST(amount AS DOUBLE), NULL FROM ledger WHERE amount >= 200 AND month = '{MONTH}' ORDER BY ledger.amount DESC, txn_id LIMIT 10)
UNION ALL SELECT 'bill', b.name, CASE WHEN b.bill_idx IN (SELECT bill_idx FROM hits WHERE month = '{MONTH}') THEN 1.0 ELSE 0.0 END, NULL FROM bills b
UNION ALL SELECT 'summary', month, round(spend, 2), CASE WHEN has THEN round(spend - prior, 2) END FROM ms WHERE month = '{MONTH}' AND scope = 'household') SELECT * FROM facts""")
def month_fact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of a month's facts: categories, movers, holders, large charges, bills and the summary."""
    found = overview.month_facts(t.ledger(spark, sf_dir), t.bills(spark), MONTH)
    none = F.lit(None).cast("double")
    of = lambda k, part, name, value, more=none: found[k].select(F.lit(part).alias("part"), F.col(name).alias("name"), F.round(value.cast("double"), 2).alias("value"), more.cast("double").alias("more"))
    parts = [
        of("categories", "category", "category", F.col("total"), F.col("delta")), of("movers", "mover", "category", F.col("total"), F.col("delta")), of("holders", "holder", "name", F.col("total")),
        of("large_charges", "charge", "merchant", F.col("amount")), of("bills", "bill", "bill", F.when(F.col("status") == "seen", 1.0).otherwise(0.0)), of("summary", "summary", "month", F.col("spend_total"), F.col("spend_delta")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(""", totals AS (SELECT month, coalesce(category, 'Uncategorized') AS category, abs(round(CAST(sum(amount) AS DOUBLE), 2)) AS total, count(*) AS n FROM ledger GROUP BY ALL)
SELECT month, category, cents, cents < 1.5 AND (n <= 31 OR abs(n - total) < 0.015) AS grounded FROM totals, (VALUES (0), (1), (2), (100)) AS d(cents)""")
def grounded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a month's total in a category and its number of charges, which the facts leave out; right, and off by 1, 2 and 100 cents."""
    keys = [F.date_format("posted_date", "yyyy-MM").alias("month"), F.coalesce("category", F.lit("Uncategorized")).alias("category")]
    totals = t.ledger(spark, sf_dir).groupBy(*keys).agg(F.abs(F.sum("amount")).alias("total"), F.count("*").alias("n"))
    each = totals.withColumn("cents", F.explode(F.array(*map(F.lit, (0, 1, 2, 100)))))
    said = F.format_number(F.col("total") + (F.col("cents") / 100).cast("decimal(5,2)"), 2)
    facts = each.withColumns({"facts_json": F.to_json(F.struct(F.col("total").cast("double").alias("net"))), "reply": F.concat(F.lit("You spent $"), said, F.lit(" in "), "n", F.lit(" charges."))})
    return ledgerqa.grounded_replies(facts).select("month", "category", "cents", "grounded")


# --- clusters and proposals -------------------------------------------------------------------------------------------


@query()
def cluster_unknowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_unknowns(t.ledger(spark, sf_dir)).withColumn("members", F.array_join("members", ";"))


@query()
def alias_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merchants.alias_patterns(cluster.cluster_unknowns(t.ledger(spark, sf_dir)))


@query(r"SELECT DISTINCT normalized_merchant, '(?i)' || regexp_replace(regexp_replace(normalized_merchant, '([\\.^$|?*+()\[\]{}\-#&~])', '\\\1', 'g'), ' ', '\\s+', 'g') AS pattern FROM ledger")
def rule_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t.ledger(spark, sf_dir).select("normalized_merchant").distinct()
    return names.withColumn("pattern", text.rule_pattern("normalized_merchant"))


#: The ledger after a reader has filed three quarters of the open rows by hand, one in twelve of them under another category.
_FILED = "((coalesce(classified_by, '') NOT IN ('manual', 'rule', 'merchant') OR coalesce(category, '') IN ('', 'Uncategorized')) AND txn_id[2] < 'c')"
_REVIEWED = f""", reviewed AS (SELECT * REPLACE (CASE WHEN {_FILED} THEN CASE WHEN txn_id[2] = '0' THEN 'Food' ELSE 'Other' END ELSE category END AS category,
  CASE WHEN {_FILED} THEN 'manual' ELSE classified_by END AS classified_by) FROM ledger)"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.substring("txn_id", 2, 1)
    filed = classify.is_open() & (digit < "c")
    return t.ledger(spark, sf_dir).withColumns({
        "category": F.when(filed, F.when(digit == "0", "Food").otherwise("Other")).otherwise(F.col("category")),
        "classified_by": F.when(filed, "manual").otherwise(F.col("classified_by")),
    })


_PROFILES = """, k AS (SELECT *, lower(coalesce(canonical_merchant, normalized_merchant)) AS key FROM ledger),
h AS (SELECT key, sum(n) AS hn, max(n) AS top, arg_min(category, (-n, category)) AS cat FROM (SELECT key, category, count(*) AS n FROM k WHERE category IS NOT NULL AND classified_by IN ('manual', 'rule', 'merchant') GROUP BY ALL) GROUP BY 1),
o AS (SELECT key, count(*) AS n, sum(amount) AS total, list_sort(list(txn_id)) AS txn_ids FROM k WHERE coalesce(classified_by, '') NOT IN ('manual', 'rule', 'merchant') OR coalesce(category, '') IN ('', 'Uncategorized') GROUP BY 1),
prof AS (SELECT key, CAST(n AS BIGINT) AS txn_count, round(CAST(total AS DOUBLE), 2) AS total_amount, CASE WHEN hn >= 3 THEN cat END AS history_category, CASE WHEN hn >= 3 THEN round(top / hn, 3) ELSE 0.0 END AS history_ratio, CAST(coalesce(hn, 0) AS BIGINT) AS history_count, txn_ids FROM o LEFT JOIN h USING (key)) """
_HISTORY = _REVIEWED + _PROFILES.replace("FROM ledger", "FROM reviewed")
#: The queue of answers that history gives, as its rows are stored.
_HISTORY_QUEUE = _HISTORY + """, printed AS (SELECT *, substring(sha256('1|category|' || CAST(to_json({'history_category': history_category, 'history_ratio': history_ratio, 'key': key, 'txn_ids': txn_ids}) AS VARCHAR)), 1, 24) AS input_fingerprint
  FROM prof WHERE history_ratio >= 0.9 AND history_count >= 3),
queue AS (SELECT *, substring(sha256(input_fingerprint || '|2026-01-01T00:00:00'), 1, 16) AS proposal_id FROM printed) """


@query(_PROFILES + "SELECT * EXCLUDE (txn_ids) FROM prof")
def category_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proposals.category_profiles(t.ledger(spark, sf_dir))
    return _with(found.select("key", "txn_count", "total_amount", "history_category", "history_ratio", "history_count"), "total_amount")


@query()
def merchant_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = proposals.merchant_profiles(t.ledger(spark, sf_dir))
    return _with(found.select("key", "txn_count", "total_amount", F.size("members").alias("members"), F.size("txn_ids").alias("txn_ids")), "total_amount")


def _stub(profiles: list[dict]) -> list[dict]:
    """Answers by the first letter of the key: a brand, a category as brand, an unknown category."""
    out = []
    for p in profiles:
        kind = sum(map(ord, p["key"])) % 3
        out.append({"key": p["key"], "canonical": ("Acme", "food", "")[kind], "category": ("Food", "", "Nonsense")[kind], "confidence": "high", "reason": 'It is "Best Shop" by name.'})
    return out


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = proposals.merchant_profiles(t.ledger(spark, sf_dir))
    answered = proposals.sanitize_answers(proposals.score_profiles(profiles, _stub), t.CATEGORIES)
    return proposals.make_proposals(answered, "stub", "2026-01-01T00:00:00")


@query()
def score_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir).select("input_fingerprint", "confidence", "recommendation_json")


@query(_HISTORY + "SELECT key, history_category AS category, 'high' AS confidence FROM prof WHERE history_ratio >= 0.9 AND history_count >= 3")
def history_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.history_answers(proposals.category_profiles(_reviewed(spark, sf_dir))).select("key", "category", "confidence")


@query()
def merge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    return proposals.merge_proposals(queue.where("confidence = 'low'"), queue, "incremental").groupBy("confidence").agg(F.count("*").alias("n"))


@query()
def list_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.list_proposals(_queue(spark, sf_dir)).select("input_fingerprint", "confidence", "impact")


@query()
def apply_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    decisions = queue.where("confidence = 'high'").select("proposal_id", F.lit("accept").alias("action"), F.lit(None).cast("string").alias("recommendation_json"), F.lit(True).alias("save_as_rule"))
    out = proposals.apply_proposals(t.ledger(spark, sf_dir), queue, decisions, t.CATEGORIES, "batch-1", "2026-01-02T00:00:00")
    return out["ledger"].where("merchant_source = 'manual'").groupBy("canonical_merchant", "category").agg(F.count("*").alias("n"))


@query()
def rollback_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir).withColumns({"status": F.lit("accepted"), "batch_id": F.lit("batch-1")})
    return proposals.rollback_proposals(queue, "batch-1", "2026-01-03T00:00:00").groupBy("status").agg(F.count("*").alias("n"))


def _history_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.make_proposals(proposals.history_answers(proposals.category_profiles(_reviewed(spark, sf_dir))), "history", "2026-01-01T00:00:00")


def _decided(spark: SparkSession, sf_dir: str, queue: DataFrame) -> dict[str, DataFrame]:
    """The queue after decisions by the first digit of the ids; the last quarter of them stays."""
    action = F.when(F.col("proposal_id") < "8", "accept").when(F.col("proposal_id") < "a", "reject").when(F.col("proposal_id") < "c", "defer")
    decisions = queue.select("proposal_id", action.alias("action"), F.lit(None).cast("string").alias("recommendation_json"), F.lit(True).alias("save_as_rule")).where("action is not null")
    return proposals.apply_proposals(_reviewed(spark, sf_dir), queue, decisions, t.CATEGORIES, "batch-1", "2026-01-02T00:00:00")


_HISTORY_STATUS = "CASE WHEN proposal_id < '8' THEN 'accepted' WHEN proposal_id < 'a' THEN 'rejected' WHEN proposal_id < 'c' THEN 'deferred' ELSE 'pending' END"


@query(_HISTORY_QUEUE + "SELECT proposal_id, input_fingerprint, 'category' AS kind, 'pending' AS status, history_category AS category, 'true' AS reusable, CAST(len(txn_ids) AS INTEGER) AS txns FROM queue")
def history_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals from history as stored rows: ids, fingerprints and recommendations."""
    said = F.col("recommendation_json")
    return _history_queue(spark, sf_dir).select(
        "proposal_id", "input_fingerprint", "kind", "status", F.get_json_object(said, "$.category").alias("category"), F.get_json_object(said, "$.reusable").alias("reusable"),
        F.size(F.from_json("txn_ids_json", "array<string>")).alias("txns"),
    )


@query(_HISTORY_QUEUE + "SELECT proposal_id, abs(total_amount) AS impact FROM queue ORDER BY abs(total_amount) DESC, proposal_id LIMIT 50 OFFSET 10")
def list_history_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals.list_proposals(_history_queue(spark, sf_dir), kind="category", limit=50, offset=10).select("proposal_id", "impact")


@query(_HISTORY_QUEUE + f""", existing AS (SELECT input_fingerprint, {_HISTORY_STATUS} AS status FROM queue WHERE proposal_id < 'e'),
merged AS (SELECT 'full' AS mode, status FROM existing WHERE status NOT IN ('pending', 'deferred') UNION ALL SELECT 'full', 'pending' FROM queue
  UNION ALL SELECT 'incremental', status FROM existing UNION ALL SELECT 'incremental', 'pending' FROM queue WHERE input_fingerprint NOT IN (SELECT input_fingerprint FROM existing WHERE status IN ('pending', 'deferred')))
SELECT mode, status, CAST(count(*) AS BIGINT) AS n FROM merged GROUP BY ALL""")
def merge_history_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue partly decided, and one that lacks some rows, after the same profiles are proposed again in both modes."""
    created = _history_queue(spark, sf_dir)
    status = F.when(F.col("proposal_id") < "8", "accepted").when(F.col("proposal_id") < "a", "rejected").when(F.col("proposal_id") < "c", "deferred").otherwise("pending")
    existing = created.where("proposal_id < 'e'").withColumn("status", status)
    both = [proposals.merge_proposals(existing, created, mode).select(F.lit(mode).alias("mode"), "status") for mode in ("full", "incremental")]
    return both[0].unionByName(both[1]).groupBy("mode", "status").agg(F.count("*").alias("n"))


@query(_HISTORY_QUEUE + """, hit AS (SELECT unnest(txn_ids) AS txn_id, history_category FROM queue WHERE proposal_id < '8')
SELECT r.txn_id, coalesce(h.history_category, r.category) AS category, CASE WHEN h.txn_id IS NOT NULL THEN 'manual' ELSE r.classified_by END AS classified_by FROM reviewed r LEFT JOIN hit h USING (txn_id)""")
def apply_history_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the ledger after accepted proposals took effect."""
    return _decided(spark, sf_dir, _history_queue(spark, sf_dir))["ledger"].select("txn_id", "category", "classified_by")


@query(_HISTORY_QUEUE + """SELECT CASE WHEN max(canonical_merchant) IS NOT NULL THEN 'canonical' ELSE 'exact' END AS kind, coalesce(max(canonical_merchant), arg_min(normalized_merchant, k.txn_id)) AS pattern, max(history_category) AS category
FROM queue JOIN k USING (key) WHERE proposal_id < '8' AND list_contains(txn_ids, k.txn_id) GROUP BY key""")
def rules_of_history_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that accepted proposals leave behind."""
    return _decided(spark, sf_dir, _history_queue(spark, sf_dir))["rules"].select("kind", "pattern", "category")


@query(_HISTORY_QUEUE + f"SELECT proposal_id, {_HISTORY_STATUS} AS decided, 'pending' AS rolled_back FROM queue")
def rollback_history_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each proposal's status after a batch of decisions, and after its rollback."""
    decided = _decided(spark, sf_dir, _history_queue(spark, sf_dir))["proposals"]
    back = proposals.rollback_proposals(decided, "batch-1", "2026-01-03T00:00:00").select("proposal_id", F.col("status").alias("rolled_back"))
    return decided.select("proposal_id", F.col("status").alias("decided")).join(back, "proposal_id")


@query(_PROFILES + """, asked AS (SELECT key, list_sum([ord(c) for c in string_split(key, '')]) % 3 AS kind FROM prof)
SELECT key, CASE kind WHEN 0 THEN 'Acme' ELSE 'Best Shop' END AS brand, CASE kind WHEN 2 THEN '' ELSE 'Food' END AS category, CASE kind WHEN 0 THEN 'high' ELSE 'low' END AS confidence, kind <> 0 AS ambiguous FROM asked""")
def sanitize_category_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers on open merchants: a brand; a category as brand, which becomes the category; an unknown category, which goes."""
    answered = proposals.score_profiles(proposals.category_profiles(t.ledger(spark, sf_dir)), _stub)
    return proposals.sanitize_answers(answered, t.CATEGORIES).select("key", F.col("answer_canonical").alias("brand"), "category", "confidence", "ambiguous")


# --- statement text ---------------------------------------------------------------------------------------------------


def _statement_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each derived document written out as a CSV export with debit and credit columns; every seventh also a second time."""
    rows = t.raw(spark, sf_dir)
    quoted = F.concat(F.lit('"'), "raw_description", F.lit('"'))
    money = F.abs("amount").cast("string")
    line = F.concat_ws(",", F.date_format("posted_date", "MM/dd/yyyy"), quoted, F.when(F.col("amount") >= 0, money).otherwise(""), F.when(F.col("amount") < 0, money).otherwise(""))
    lines = rows.groupBy("source_document_id").agg(F.array_sort(F.collect_list(F.struct("source_row", line.alias("line")))).alias("lines"))
    body = F.concat(F.lit("Date,Description,Debit,Credit\n"), F.array_join(F.transform("lines", lambda r: r["line"]), "\n"))
    docs = lines.select(F.col("source_document_id").alias("card"), body.alias("body"), F.explode(F.sequence(F.lit(0), F.when(F.crc32("source_document_id") % 7 == 0, 1).otherwise(0))).alias("copy"))
    content = F.encode("body", "UTF-8")
    return docs.select(
        F.sha2(content, 256).alias("document_id"), F.concat("card", F.col("copy").cast("string")).alias("card"), F.lit(False).alias("at_root"), F.concat("card", F.lit("/"), "copy", F.lit(".csv")).alias("source_file"),
        F.lit("csv").alias("suffix"), content.alias("content"), F.lit(None).cast("string").alias("card_issuer"), F.lit(None).cast("string").alias("card_product"),
    )


@query("SELECT posted_date, CAST(amount AS DOUBLE) AS amount, CAST(count(*) AS BIGINT) AS rows FROM raw GROUP BY ALL")
def parse_csv_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.route_documents(documents.dedupe_documents(_statement_documents(spark, sf_dir)))
    rows, _ = statements.parse_csv_statements(docs)
    return rows.groupBy("posted_date", F.col("amount").cast("double").alias("amount")).agg(F.count("*").alias("rows"))


@query("SELECT coalesce(status, 'parse') AS status, CAST(count(*) AS BIGINT) AS documents FROM (SELECT DISTINCT source_document_id, NULL AS status FROM raw) GROUP BY 1")
def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left to parse after identical copies are marked."""
    docs = documents.route_documents(documents.dedupe_documents(_statement_documents(spark, sf_dir)))
    return docs.where("status is null").groupBy(F.coalesce("status", F.lit("parse")).alias("status")).agg(F.count("*").alias("documents"))


@query("SELECT source_document_id, source_row, CAST(amount AS DOUBLE) AS amount FROM raw")
def parse_amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written as $1,234.50, (1,234.50) or 1,234.50-, read back."""
    shown = F.format_number(F.abs("amount"), 2)
    text_ = F.when(F.col("amount") >= 0, F.concat(F.lit("$"), shown)).when(F.col("source_row") % 2 == 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(F.concat(shown, F.lit("-")))
    return t.raw(spark, sf_dir).select("source_document_id", "source_row", parse.parse_amount(text_).cast("double").alias("amount"))


@query("SELECT source_document_id, source_row, posted_date FROM raw")
def parse_date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in three forms, read back."""
    form = [F.date_format("posted_date", f) for f in ("MM/dd/yyyy", "yyyy-MM-dd", "MMM d, yyyy")]
    text_ = F.when(F.col("source_row") % 3 == 0, form[0]).when(F.col("source_row") % 3 == 1, form[1]).otherwise(form[2])
    return t.raw(spark, sf_dir).select("source_document_id", "source_row", parse.parse_date(text_).alias("posted_date"))


@query("SELECT source_document_id, source_row, posted_date FROM raw")
def resolve_cycle_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month and day alone, put back into a billing cycle of 28 days around the date."""
    rows = t.raw(spark, sf_dir).withColumn("p", parse.parse_month_day(F.date_format("posted_date", "M/d")))
    start = F.date_sub("posted_date", (F.col("source_row") % 28).cast("int"))
    return rows.select("source_document_id", "source_row", parse.resolve_cycle_date(F.col("p.month"), F.col("p.day"), start, F.date_add(start, 27)).alias("posted_date"))


@query("SELECT source_document_id AS document_id, posted_date, CAST(abs(amount) AS DOUBLE) AS amount, raw_description FROM raw GROUP BY ALL")
def parse_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of date, description and amount, equal ones of a document once."""
    line = F.concat_ws("  ", F.date_format("posted_date", "MM/dd/yyyy"), "raw_description", F.concat(F.lit("$"), F.format_number(F.abs("amount"), 2)))
    lines = t.raw(spark, sf_dir).select(F.col("source_document_id").alias("document_id"), F.col("source_row").alias("line_no"), line.alias("text"))
    return statements.parse_text_lines(lines).select("document_id", "posted_date", F.col("amount").cast("double").alias("amount"), "raw_description")


@query("SELECT DISTINCT card_issuer, card_product, (card_issuer, coalesce(card_product, '')) NOT IN (SELECT (issuer, product) FROM products) AND card_issuer IN (SELECT issuer FROM products) AS outside FROM raw")
def products_outside_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuer and product pairs of the ledger that the product vocabulary lacks (issuers renamed to ones it can know)."""
    names = {"BUILDING": "Chase", "AUTOMOBILE": "Wells Fargo"}
    pairs = [F.lit(x) for p in names.items() for x in p]
    rows = t.raw(spark, sf_dir).select("card_issuer", "card_product").distinct()
    vocabulary = t.products(spark).withColumn("issuer", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("issuer")), "issuer"))
    found = documents.resolve_product(rows.withColumn("issuer", F.try_element_at(F.create_map(*pairs), F.col("card_issuer"))), vocabulary, "issuer", "card_product")
    return found.select("card_issuer", "card_product", F.col("needs_selection").alias("outside"))


from . import statement_queries  # noqa: E402, F401  registers its queries
