"""Registered queries on documents: the ledger's rows laid out as statements of each issuer and read back, documents and their
identity, the store and what leaves it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import maintenance, merchants, recurring, reports
from ..operators.identity import normalize
from ..sources import documents, statements, store
from ..streaming.ingest import ingest, stream_ingest
from ..tables import kept, shared_folder
from . import testledger as t
from .registry import _with, query

ISSUERS = ("Chase", "Capital One", "Wells Fargo")
HOLDERS = ("Alex Example", "Sam Example", "Kim Example", "Lee Example")
#: Where each issuer's cells stand: date, posting date, reference, description, amount or credit, charge.
PLACES = {"Chase": (10, None, None, 100, 400, 400), "Capital One": (10, 90, None, 170, 420, 420), "Wells Fargo": (10, 60, 110, 200, 430, 500)}

#: The raw rows of monthly documents with issuer and holder by their card, as DuckDB reads them.
_DOCS = """, docs AS (SELECT source_document_id AS document_id, posted_date, amount, raw_description, source_row, CAST(substring(card, 6) AS INTEGER) AS k,
  ['Chase', 'Capital One', 'Wells Fargo'][CAST(substring(card, 6) AS INTEGER) % 3 + 1] AS issuer, CASE WHEN cardholder IS NOT NULL THEN ['Alex Example', 'Sam Example', 'Kim Example', 'Lee Example'][CAST(substring(card, 6) AS INTEGER) % 4 + 1] END AS holder
  FROM raw WHERE source_document_id LIKE 'doc-%') """


def _once(build: Callable) -> Callable:
    """What is built for a folder stays in the shared folder for later queries of the application, as jobs share a stored table."""
    known: dict = {}

    def get(spark: SparkSession, *args):
        key = (spark.sparkContext.applicationId, *args)
        if key not in known:
            known[key] = build(spark, *args)
        return known[key]

    return get


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("card", 6, 9).cast("int")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), k % n + 1)
    rows = t.raw(spark, sf_dir).where("source_document_id like 'doc-%'").withColumnRenamed("source_document_id", "document_id")
    return rows.withColumns({"issuer": pick(ISSUERS, 3), "holder": F.when(F.col("cardholder").isNotNull(), pick(HOLDERS, 4))})


def _cell(x: int | float, text: Column | str) -> Column:
    return F.struct(F.lit(float(x)).alias("x"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def laid_out(spark: SparkSession, sf_dir: str, totals: bool = False) -> DataFrame:
    """(document_id, page, text, x0, top): the words of a statement of each monthly document: issuer, product, holder and period, then
    payments (what is negative) and purchases, each under a heading, in the issuer's columns, signs and forms of dates; pages of 60
    lines. With `totals`, Capital One prints its totals and balances, off by 1.00 in every fifth card and every seventh month."""
    rows = _rows(spark, sf_dir)
    paid = F.col("amount") < 0
    by = lambda **v: F.coalesce(*[F.when(F.col("issuer") == n, c) for n, c in zip(ISSUERS, v.values())])
    shown = F.concat(F.when(paid & (F.col("issuer") == "Chase"), "-").otherwise(""), F.when(F.col("issuer") == "Capital One", "$").otherwise(""), F.format_number(F.abs("amount"), 2))
    day, short = F.date_format("posted_date", "MM/dd"), F.date_format("posted_date", "MMM d")
    cells = {}
    for n, (date, post, reference, description, credit, charge) in PLACES.items():
        form = short if n == "Capital One" else day
        own = [_cell(date, form), *([_cell(post, form)] if post else []), *([_cell(reference, "R1")] if reference else []), _cell(description, F.col("raw_description"))]
        cells[n] = F.array(*own, F.when(paid, _cell(credit, shown)).otherwise(_cell(charge, shown)))
    body = rows.select("document_id", F.when(paid, 2).otherwise(4).alias("part"), F.col("source_row").alias("at"), by(**cells_by(cells)).alias("cells"))
    heads = rows.groupBy("document_id").agg(
        F.first("issuer").alias("issuer"), F.first("holder").alias("holder"), F.trunc(F.min("posted_date"), "month").alias("start"), F.first("card").alias("card"),
        F.coalesce(F.sum(F.when(paid, F.col("amount"))), F.lit(0)).cast("decimal(28,2)").alias("paid"), F.coalesce(F.sum(F.when(~paid, F.col("amount"))), F.lit(0)).cast("decimal(28,2)").alias("spent"),
    ).withColumn("end", F.last_day("start"))
    line = lambda part, at, *cells: F.struct(F.lit(part).alias("part"), F.lit(at).cast("long").alias("at"), F.array(*cells).alias("cells"))
    numeric = lambda f: F.concat(F.date_format("start", f), F.lit(" - "), F.date_format("end", f))
    money = lambda c: F.concat(F.lit("$"), F.format_number(F.abs(c), 2))
    off_total, off_balance = _off()
    chase = [line(0, 0, _cell(10, "CHASE PRIME VISA")), line(0, 1, _cell(10, F.upper(F.coalesce("holder", F.lit("ACCOUNT SUMMARY"))))), line(0, 2, _cell(10, F.concat(F.lit("Opening/Closing Date "), numeric("MM/dd/yyyy")))), line(0, 3, _cell(10, "CASH ADVANCES")),
             line(1, 0, _cell(10, "Date"), _cell(100, "Merchant Name"), _cell(400, "$ Amount")), line(1, 1, _cell(10, "PAYMENTS AND OTHER CREDITS")), line(3, 0, _cell(10, "PURCHASE"))]
    owner = lambda s: F.concat(F.coalesce(F.concat("holder", F.lit(": ")), F.lit("")), F.lit(s))
    capital = [line(0, 0, _cell(10, "Capital One Savor Credit Card | Mastercard ending in 1")), line(0, 1, _cell(10, F.concat(F.date_format("start", "MMM d, yyyy"), F.lit(" - "), F.date_format("end", "MMM d, yyyy"), F.lit(" | Billing Cycle")))),
               line(1, 0, _cell(10, owner("Payments, Credits and Adjustments"))), line(1, 1, _cell(10, "Trans Date"), _cell(90, "Post Date"), _cell(170, "Description"), _cell(420, "Amount")), line(3, 0, _cell(10, owner("Transactions")))]
    if totals:
        balances = {"Previous Balance ": F.lit(100), "Payments ": F.col("paid"), "Other Credits ": F.lit(0), "Transactions ": F.col("spent"), "Cash Advances ": F.lit(0), "Fees Charged ": F.lit(0), "Interest Charged ": F.lit(0), "New Balance ": 100 + F.col("paid") + F.col("spent") + off_balance}
        signed = lambda c: F.concat(F.when(c < 0, "-").otherwise(""), money(c))
        capital += [line(0, 2 + i, _cell(10, F.concat(F.lit(n), signed(c.cast("decimal(28,2)"))))) for i, (n, c) in enumerate(balances.items())]
        capital.append(line(5, 0, _cell(10, F.concat(F.lit("Total Transactions for This Period "), money(F.col("spent") + off_total)))))
    wells = [line(0, 0, _cell(10, "WELLS FARGO AUTOGRAPH VISA CARD")), line(0, 1, _cell(10, F.upper(F.regexp_replace(F.coalesce("holder", F.lit("ACCOUNT SUMMARY CARD")), " ", " Q ")))), line(0, 2, _cell(10, F.concat(F.lit("Statement Period "), F.date_format("start", "MM/dd/yyyy"), F.lit(" to "), F.date_format("end", "MM/dd/yyyy")))),
             line(1, 0, _cell(10, "Trans"), _cell(60, "Post"), _cell(110, "Reference"), _cell(200, "Description"), _cell(430, "Credits"), _cell(500, "Charges")), line(1, 1, _cell(10, "Payments")), line(3, 0, _cell(10, "Purchases, Balance Transfers & Other Charges"))]
    fixed = heads.select("document_id", F.explode(by(a=F.array(*chase), b=F.array(*capital), c=F.array(*wells))).alias("l")).select("document_id", "l.part", "l.at", "l.cells")
    lines = body.unionByName(fixed).withColumn("n", F.row_number().over(W.partitionBy("document_id").orderBy("part", "at")) - 1)
    words = lines.select("document_id", (F.col("n") / 60).cast("int").alias("page"), (F.col("n") % 60 * 12.0).alias("top"), F.explode("cells").alias("c"))
    return words.select("document_id", "page", "top", F.col("c.x").alias("x"), F.posexplode(F.split("c.text", " ")).alias("i", "text")).select("document_id", "page", "text", (F.col("x") + F.col("i") * 20.0).alias("x0"), "top")


def cells_by(cells: dict[str, Column]) -> dict[str, Column]:
    return dict(zip("abc", (cells[n] for n in ISSUERS)))


def _off() -> tuple[Column, Column]:
    """What is planted in printed totals and new balances."""
    return F.when(F.substring("card", 6, 9).cast("int") % 5 == 1, 1).otherwise(0), F.when(F.month("start") % 7 == 1, 1).otherwise(0)


@_once
def _lines(spark: SparkSession, sf_dir: str, totals: bool = False) -> DataFrame:
    """The lines of the laid-out words."""
    return kept(statements.words_to_lines(laid_out(spark, sf_dir, totals)))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    found = kept(statements.statement_metadata(lines))
    parts = [kept(statements.parse_word_statements(lines, found, n)[0]) for n in ISSUERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_DOCS + "SELECT document_id, posted_date, CAST(amount AS DOUBLE) AS amount, raw_description, issuer AS card_issuer, holder AS cardholder, CASE WHEN amount < 0 THEN 'payments' WHEN issuer = 'Capital One' THEN 'transactions' ELSE 'purchases' END AS section FROM docs")
def parse_word_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every laid-out statement, read back from its words."""
    return _parsed(spark, sf_dir).select("document_id", "posted_date", F.col("amount").cast("double").alias("amount"), "raw_description", "card_issuer", "cardholder", "section")


@query(_DOCS + "SELECT document_id, issuer, CASE issuer WHEN 'Chase' THEN 'Amazon Prime Visa' WHEN 'Capital One' THEN 'Savor' ELSE 'Autograph Visa' END AS product, date_trunc('month', min(posted_date))::DATE AS cycle_start, last_day(min(posted_date)) AS cycle_end, CASE WHEN issuer <> 'Capital One' THEN max(holder) END AS cardholder FROM docs GROUP BY document_id, issuer")
def statement_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuer, product, period and holder of each laid-out statement, between headings in capitals that are no names."""
    lines = _lines(spark, sf_dir)
    return statements.statement_metadata(lines).select("document_id", "issuer", "product", "cycle_start", "cycle_end", "cardholder")


@query(_DOCS + ", n AS (SELECT document_id, issuer, count(*) FILTER (amount < 0) AS a, count(*) FILTER (amount >= 0) AS b FROM docs GROUP BY 1, 2) SELECT document_id, CAST(a + b + CASE issuer WHEN 'Chase' THEN 7 WHEN 'Capital One' THEN 5 ELSE 6 END AS BIGINT) AS lines, CAST(ceil((a + b + CASE issuer WHEN 'Chase' THEN 7 WHEN 'Capital One' THEN 5 ELSE 6 END) / 60) AS BIGINT) AS pages FROM n")
def words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to lines: as many lines and pages as were laid out."""
    lines = _lines(spark, sf_dir)
    return lines.groupBy("document_id").agg(F.count("*").alias("lines"), F.count_distinct("page").alias("pages"))


@query(_DOCS + "SELECT document_id, 'transactions' AS section, CAST(coalesce(sum(amount) FILTER (amount >= 0), 0) AS DOUBLE) AS extracted, CAST(coalesce(sum(amount) FILTER (amount >= 0), 0) + 1 AS DOUBLE) AS declared FROM docs WHERE issuer = 'Capital One' AND k % 5 = 1 GROUP BY 1")
def validate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose rows don't add up to their printed total: those with a planted error."""
    lines = _lines(spark, sf_dir, True)
    found = statements.statement_metadata(lines)
    rows, _ = statements.parse_word_statements(lines, found, "Capital One")
    declared = statements.declared_totals(lines.join(found.where("issuer = 'Capital One'").select("document_id"), "document_id", "left_semi"))
    return statements.validate_totals(rows, declared).select("document_id", "section", F.col("extracted").cast("double").alias("extracted"), F.col("declared").cast("double").alias("declared"))


@query(_DOCS + "SELECT document_id, CAST(100 + sum(amount) AS DOUBLE) AS calculated, CAST(101 + sum(amount) AS DOUBLE) AS new_balance FROM docs WHERE issuer = 'Capital One' AND month(posted_date) % 7 = 1 GROUP BY 1")
def validate_account_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose balances don't add up: those with a planted error."""
    found = statements.validate_account_summary(_lines(spark, sf_dir, True))
    return found.select("document_id", F.col("calculated").cast("double").alias("calculated"), F.col("new_balance").cast("double").alias("new_balance"))


@query("SELECT raw_description, CAST(count(*) AS BIGINT) AS n, raw_description AS halved FROM raw GROUP BY raw_description")
def collapse_doubled_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors printed with each letter twice, and read back."""
    names = t.raw(spark, sf_dir).groupBy("raw_description").agg(F.count("*").alias("n"))
    twice = F.regexp_replace("raw_description", r"(\p{L})", "$1$1")
    return names.withColumn("halved", statements.collapse_doubled_glyphs(twice))


# --- documents --------------------------------------------------------------------------------------------------------


def _exports(spark: SparkSession, sf_dir: str, issuer: str) -> DataFrame:
    """The monthly documents as CSV exports in the issuer's form, routed."""
    rows = _rows(spark, sf_dir)
    quoted, day = F.concat(F.lit('"'), "raw_description", F.lit('"')), F.date_format("posted_date", "MM/dd/yyyy")
    paid = F.col("amount") < 0
    if issuer == "Chase":  # what was spent is negative there, and payments say so
        head = "Transaction Date,Post Date,Description,Category,Type,Amount,Memo"
        line = F.concat_ws(",", F.date_format(F.date_sub("posted_date", 1), "MM/dd/yyyy"), day, quoted, F.lit("Any"), F.when(paid, "Payment").otherwise("Sale"), F.when(paid, F.abs("amount")).otherwise(-F.col("amount")).cast("string"), F.lit(""))
    else:
        head = "Date,Description,Card Member,Account #,Amount"
        line = F.concat_ws(",", day, quoted, F.upper(F.coalesce("holder", F.lit(""))), F.lit("-1"), F.col("amount").cast("string"))
    lines = rows.groupBy("document_id", "card").agg(F.array_sort(F.collect_list(F.struct("source_row", line.alias("line")))).alias("lines"))
    content = F.encode(F.concat(F.lit(head + "\n"), F.array_join(F.transform("lines", lambda r: r["line"]), "\n")), "UTF-8")
    # Every third Amex upload lacks its product and has to fail.
    product = F.when((F.substring("card", 6, 9).cast("int") % 3 != 0) | F.lit(issuer == "Chase"), "Gold")
    docs = lines.select("document_id", F.lit(issuer.lower() + "-x").alias("card"), F.concat("document_id", F.lit(".csv")).alias("source_file"), F.lit("csv").alias("suffix"), content.alias("content"), F.lit(None if issuer == "Chase" else "American Express").cast("string").alias("card_issuer"), product.alias("card_product"), F.lit(None).cast("string").alias("status"))
    return documents.route_documents(docs)


@query(_DOCS + "SELECT document_id, posted_date, CAST(amount AS DOUBLE) AS amount, raw_description, 'Chase' AS card_issuer FROM docs")
def parse_chase_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chase's CSV exports: the posting date, and signs turned by type."""
    rows, _ = statements.parse_csv_statements(_exports(spark, sf_dir, "Chase"))
    return rows.select(F.col("source_document_id").alias("document_id"), "posted_date", F.col("amount").cast("double").alias("amount"), "raw_description", "card_issuer")


@query(_DOCS + "SELECT document_id, posted_date, CAST(amount AS DOUBLE) AS amount, raw_description, holder AS cardholder, 'Gold' AS card_product FROM docs WHERE k % 3 <> 0")
def parse_amex_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """American Express exports: holders by row; uploads without a product fail as a whole."""
    rows, _ = statements.parse_csv_statements(_exports(spark, sf_dir, "Amex"))
    return rows.select(F.col("source_document_id").alias("document_id"), "posted_date", F.col("amount").cast("double").alias("amount"), "raw_description", "cardholder", "card_product")


@query(_DOCS + "SELECT document_id, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'parsed' END AS status, CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE count(*) END AS BIGINT) AS row_count, CASE WHEN k % 3 = 0 THEN 'issuer and product must be selected' END AS error FROM docs GROUP BY document_id, k")
def statement_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All or nothing: the status, rows and error of each American Express upload."""
    return statements.parse_csv_statements(_exports(spark, sf_dir, "Amex"))[1]


@query("""SELECT DISTINCT source_document_id AS document_id, n, CASE WHEN n = 0 THEN NULL ELSE 'duplicate_document' END AS status
FROM raw, (VALUES (0), (1), (2)) AS c(n) WHERE n = 0 OR (n = 1 AND card LIKE '%3') OR (n = 2 AND card LIKE '%13')""")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents in later folders and in the inbox itself, and which of them are left to parse."""
    docs = t.raw(spark, sf_dir).select(F.col("source_document_id").alias("document_id"), "card").distinct()
    copies = F.array(F.lit(0), F.when(F.col("card").endswith("3"), 1), F.when(F.col("card").endswith("13"), 2))
    each = docs.withColumn("n", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    each = each.select("document_id", "n", F.when(F.col("n") == 2, "generic").otherwise(F.concat(F.lit("folder-"), "n")).alias("card"), (F.col("n") == 2).alias("at_root"), F.concat("document_id", "n").alias("source_file"), F.encode("document_id", "UTF-8").alias("content"))
    return documents.dedupe_documents(each).select("document_id", "n", "status")


@query("""SELECT DISTINCT source_document_id AS document_id, ['amex', 'chase', 'capital_one', 'wells_fargo', 'bank_of_america', 'generic'][k % 6 + 1] AS parser, CASE WHEN suffix = 'csv' AND k % 6 NOT IN (2, 3, 4) OR suffix = 'pdf' AND k % 6 NOT IN (0, 4) THEN NULL ELSE 'failed' END AS status
FROM (SELECT source_document_id, CASE WHEN source_document_id LIKE '%1' THEN 'pdf' ELSE 'csv' END AS suffix, CASE WHEN card = 'card-x' THEN 5 ELSE CAST(substring(card, 6) AS INTEGER) END AS k FROM raw)""")
def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the names of their folders, in several spellings, to parsers that can or can't read them."""
    names = F.array(*map(F.lit, ("American Express-gold", "chase_prime", "Capital-One savor", "WF card", "BoA", "my card")))
    docs = t.raw(spark, sf_dir).select(F.col("source_document_id").alias("document_id"), "card").distinct()
    named = docs.select("document_id", F.element_at(names, F.substring("card", 6, 9).cast("int") % 6 + 1).alias("card"), F.when(F.col("document_id").endswith("1"), "pdf").otherwise("csv").alias("suffix"), F.lit(None).cast("string").alias("status"))
    return documents.route_documents(named).select("document_id", "parser", "status")


@query(_DOCS + """, own AS (SELECT DISTINCT document_id, k FROM docs) SELECT document_id, CASE k % 5 WHEN 0 THEN 'Chase' WHEN 1 THEN 'American Express' WHEN 2 THEN 'Wells Fargo' WHEN 3 THEN NULL ELSE 'Capital One' END AS issuer,
CASE k % 5 WHEN 0 THEN 'Sapphire Reserve' WHEN 1 THEN 'Gold' WHEN 2 THEN 'Autograph' END AS product, CASE k % 5 WHEN 3 THEN 'manual' WHEN 4 THEN 'product_required' ELSE 'detected' END AS confidence FROM own""")
def detect_statement_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuers by header, by file name, by both brands at once (which is no answer), and products that the vocabulary knows or not."""
    docs = _rows(spark, sf_dir).select("document_id", F.substring("card", 6, 9).cast("int").alias("k")).distinct()
    header = F.element_at(F.array(*map(F.lit, ("CHASE card services", "", "Wells Fargo Bank", "Wells Fargo and Capital One", "Capital One"))), F.col("k") % 5 + 1)
    body = F.element_at(F.array(*map(F.lit, ("your sapphire reserve account, paid at AMEX", "some gold card", "WELLS FARGO AUTOGRAPH CARD", "", "Capital One Odd Credit Card | 1"))), F.col("k") % 5 + 1)
    names = F.when(F.col("k") % 5 == 1, "in/amex-july.pdf").otherwise("in/x.pdf")
    asked = docs.select("document_id", names.alias("source_file"), F.lit("pdf").alias("suffix"), header.alias("header"), body.alias("body"), F.lit(None).cast("array<string>").alias("columns"))
    vocabulary = spark.createDataFrame([("American Express", "Gold"), ("American Express", "Platinum"), ("Capital One", "Savor"), ("Wells Fargo", "Autograph")], "issuer string, product string")
    return documents.detect_statement_identity(asked, vocabulary).select("document_id", "issuer", "product", "confidence")


# --- the store and what leaves it -------------------------------------------------------------------------------------


@query("SELECT txn_id, posted_date, CAST(amount AS DOUBLE) AS amount, canonical_merchant, CASE WHEN posted_date < DATE '1996-01-01' THEN 1 WHEN posted_date < DATE '1998-01-01' THEN 2 ELSE 3 END AS part FROM ledger")
def stored_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger stored in three appends that overlap, and taken back and appended once more; with the part that holds each row."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    rows = kept(normalize(t.raw(spark, sf_dir)))

    def append(until: str) -> str:
        incoming = rows.where(F.col("posted_date") < until)
        fresh = maintenance.new_rows(store.read_ledger(spark, f"{root}/ledger", None, maintenance.span(incoming)), incoming)
        return store.append_ledger(merchants.canonicalize(fresh, t.aliases(spark)), f"{root}/ledger")

    append("1996-01-01")
    second = append("1998-01-01")
    append("9999-01-01")
    store.rollback(spark, f"{root}/ledger", second)
    append("9999-01-01")
    held = None
    for n, part in enumerate(store.parts(spark, root)["ledger"]):
        own = spark.read.parquet(f"{root}/ledger/part={part}").select("txn_id", "posted_date", F.col("amount").cast("double").alias("amount"), "canonical_merchant", F.lit(n + 1).alias("part"))
        held = own if held is None else held.unionByName(own)
    return held


@query("SELECT txn_id, card, posted_date, CAST(amount AS DOUBLE) AS amount, raw_description, normalized_merchant, canonical_merchant, merchant_source FROM ledger WHERE posted_date >= DATE '1998-01-01'")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a ledger up to 1997 lacks, as they are appended."""
    everything = normalize(t.raw(spark, sf_dir))
    _, fresh = maintenance.append_new(everything.where("posted_date < date'1998-01-01'"), everything, t.aliases(spark))
    return fresh.select("txn_id", "card", "posted_date", F.col("amount").cast("double").alias("amount"), "raw_description", "normalized_merchant", "canonical_merchant", "merchant_source")


def _written(spark: SparkSession, sf_dir: str, mode: str, names: bool) -> str:
    """The folder of a written bundle, which held the other mode's bundle before."""
    rows = t.ledger(spark, sf_dir)
    folder = f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}"
    # Used by several artefacts, each of which is written in two forms.
    found = kept(recurring.recurring(rows)).orderBy(F.desc("is_recurring"), F.desc("avg_amount"), "normalized_merchant")
    bills = kept(recurring.reconcile_bills(rows, t.bills(spark)))
    bundle = lambda m, n: reports.exports(rows, found, bills, m, n)
    if mode != "full":
        store.write_exports({"ledger": reports.publish_ledger(rows)}, folder)
    store.write_exports(bundle(mode, names), folder)
    return folder


@query("SELECT category, month, CAST(total AS DOUBLE) AS total FROM (SELECT coalesce(category, 'Uncategorized') AS category, month, round(CAST(sum(amount) AS DOUBLE), 2) AS total FROM ledger WHERE amount > 0 GROUP BY ALL) UNION ALL SELECT 'file', unnest(['category_monthly', 'reconciliation', 'recurring', 'summary']), 2.0")
def aggregate_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle of aggregates as it lies in its folder: its files (a CSV and a JSON each; the ledger's from before are gone), and what one of them says."""
    folder = _written(spark, sf_dir, "aggregates", False)
    names = spark.createDataFrame([(n.rpartition(".")[0],) for n in store._names(spark, folder) if not n.startswith("_")], "month string")
    said = spark.read.schema("month string, category string, subcategory string, total double, txn_count bigint").json(f"{folder}/category_monthly.json")
    sums = said.groupBy("category", "month").agg(F.round(F.sum("total"), 2).alias("total"))
    return sums.unionByName(names.groupBy("month").agg(F.count("*").cast("double").alias("total")).withColumn("category", F.lit("file")))


@query("SELECT txn_id, posted_date, CAST(amount AS DOUBLE) AS amount, raw_description, category, classified_by, false AS leaks FROM ledger")
def full_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as the full bundle publishes it, read from its CSV: without the names of files and documents."""
    folder = _written(spark, sf_dir, "full", True)
    rows = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/ledger.csv")
    leaks = F.lit(any(c in rows.columns for c in ("source_file", "source_document_id")))
    return rows.select("txn_id", F.col("posted_date").cast("date").alias("posted_date"), F.col("amount").cast("double").alias("amount"), "raw_description", "category", "classified_by", leaks.alias("leaks"))


# --- the landing folder -----------------------------------------------------------------------------------------------

_INGESTED = """, own AS (SELECT *, CAST(row_number() OVER (PARTITION BY card, posted_date, amount, raw_description ORDER BY source_row) - 1 AS VARCHAR) AS occ FROM raw WHERE source_document_id LIKE 'doc-%'),
landed AS (SELECT '{prefix}' || card AS card, posted_date, amount, raw_description, occ, source_document_id FROM own),
rows AS (SELECT *, substring(sha256(card || '|' || CAST(posted_date AS VARCHAR) || '|' || CAST(amount AS VARCHAR) || '|' || raw_description || '|' || occ), 1, 16) AS txn_id FROM landed)
"""


def _cells(rows: DataFrame) -> DataFrame:
    money = F.abs("amount").cast("string")
    debit, credit = F.when(F.col("amount") >= 0, money), F.when(F.col("amount") < 0, money)
    return rows.select("document_id", "card", "source_row", F.date_format("posted_date", "MM/dd/yyyy").alias("Date"), F.col("raw_description").alias("Description"), debit.alias("Debit"), credit.alias("Credit"))


@_once
def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """A store after the monthly documents came in twice; built once for each application and folder."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    line = F.concat_ws(",", "Date", F.concat(F.lit('"'), "Description", F.lit('"')), F.coalesce("Debit", F.lit("")), F.coalesce("Credit", F.lit("")))
    lines = _cells(_rows(spark, sf_dir)).groupBy("document_id", "card").agg(F.array_sort(F.collect_list(F.struct("source_row", line.alias("line")))).alias("lines"))
    content = F.encode(F.concat(F.lit("Date,Description,Debit,Credit\n"), F.array_join(F.transform("lines", lambda r: r["line"]), "\n")), "UTF-8")
    docs = kept(lines.select("document_id", "card", F.lit(False).alias("at_root"), F.concat("card", F.lit("/"), "document_id", F.lit(".csv")).alias("source_file"), F.lit("csv").alias("suffix"), content.alias("content")))
    ingest(docs, folder, t.aliases(spark))
    ingest(docs, folder, t.aliases(spark))
    return folder


@query(_INGESTED.format(prefix="") + "SELECT txn_id, card, posted_date, CAST(amount AS DOUBLE) AS amount, raw_description FROM rows")
def ingested_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after the monthly documents came in twice: every row once."""
    rows = store.read_ledger(spark, f"{_ingested(spark, sf_dir)}/ledger")
    return rows.select("txn_id", "card", "posted_date", F.col("amount").cast("double").alias("amount"), "raw_description")


@query("SELECT DISTINCT source_document_id AS document_id, n, CASE n WHEN 1 THEN 'parsed' ELSE 'duplicate_document' END AS status, CAST(CASE n WHEN 1 THEN count(*) OVER (PARTITION BY source_document_id, n) ELSE 0 END AS BIGINT) AS row_count, 'generic' AS parser FROM raw, (VALUES (1), (2)) AS c(n) WHERE source_document_id LIKE 'doc-%'")
def ingested_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest says of each document, of both times it came in."""
    found = store.read_table(spark, _ingested(spark, sf_dir), "manifest")
    return found.select("document_id", F.when(F.col("status") == "parsed", 1).otherwise(2).alias("n"), "status", "row_count", "parser")


@query(_INGESTED.format(prefix="") + "SELECT txn_id, source_document_id, CAST(occ AS BIGINT) AS source_occurrence FROM rows")
def ingested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all transactions to their documents, each once."""
    return store.read_table(spark, _ingested(spark, sf_dir), "sources").select("txn_id", "source_document_id", "source_occurrence")


@query(_INGESTED.format(prefix="card=") + "SELECT txn_id, card, posted_date, CAST(amount AS DOUBLE) AS amount, raw_description FROM rows")
def streamed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after a stream took a folder of exports, half of which came before its second run."""
    root = f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    rows = _cells(_rows(spark, sf_dir))
    for half in (0, 1):
        part = rows.where(F.crc32("card") % 2 == half).repartition("card").sortWithinPartitions("card", "source_row").drop("document_id", "source_row")
        part.write.mode("append").partitionBy("card").option("header", True).csv(f"{root}/inbox")
        stream_ingest(spark, f"{root}/inbox", f"{root}/out", f"{root}/checkpoint", t.aliases(spark)).awaitTermination()
    found = store.read_ledger(spark, f"{root}/out/ledger")
    return found.select("txn_id", "card", "posted_date", F.col("amount").cast("double").alias("amount"), "raw_description")
