"""Month overviews: totals, changes to the month before, holders, large charges, tags and bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank_or_uncategorized, strip
from .classify import clean_tags, needs_review
from .recurring import bill_charges
from .reports import charges, month_of

UNASSIGNED = "Unassigned"
#: The least large charge, how many of them and of the largest changes are shown.
LARGE_MIN, LARGE_MOST, MOVERS = 200, 10, 6


def available_months(ledger: DataFrame) -> DataFrame:
    return ledger.select(month_of().alias("month")).where("month is not null").distinct().orderBy("month")


def prior_month(month: Column | str) -> Column:
    month = F.col(month) if isinstance(month, str) else month
    return F.date_format(F.add_months(F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd"), -1), "yyyy-MM")


def holder() -> Column:
    """Trimmed name; null for blank."""
    name = strip(F.coalesce("cardholder", F.lit("")))
    return F.when(name != "", name)


def month_summaries(ledger: DataFrame) -> DataFrame:
    """One row for each month and card holder, and for the whole household (holder null): spend, the month before, the
    change, payments, what is uncategorized and what needs review. The month before counts from the ledger's first month
    on, whoever's it was. Holders without rows in a month have none."""
    charge, amount = F.col("amount") > 0, F.col("amount")
    open_ = charge & blank_or_uncategorized("category")
    rows = ledger.withColumns({"month": month_of(), "holder": holder()}).where("month is not null")
    # One pass: by month and holder, then the household from those.
    parts = rows.groupBy("month", "holder").agg(
        F.sum(F.when(charge, amount)).alias("spend"), F.count_if(charge).alias("charge_count"), F.sum(F.when(amount < 0, amount)).alias("paid"),
        F.sum(F.when(open_, amount)).alias("open_total"), F.count_if(open_).alias("open_count"), F.count_if(needs_review()).alias("review_count"),
    )
    sums = [F.sum(c).alias(c) for c in ("spend", "charge_count", "paid", "open_total", "open_count", "review_count")]
    household = parts.groupBy("month").agg(*sums).withColumn("holder", F.lit(None).cast("string"))
    both = household.withColumn("scope", F.lit("household")).unionByName(parts.where("holder is not null").withColumn("scope", F.lit("holder")))
    before = both.select(F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM").alias("_month"), F.col("scope").alias("_scope"), F.col("holder").alias("_holder"), F.coalesce("spend", F.lit(0)).alias("prior"))
    first = F.broadcast(rows.agg(F.min("month").alias("first")))
    same = (F.col("month") == F.col("_month")) & (F.col("scope") == F.col("_scope")) & F.col("holder").eqNullSafe(F.col("_holder"))
    joined = both.join(before, same, "left").crossJoin(first)
    spend, prior = F.coalesce("spend", F.lit(0)).cast("double"), F.coalesce("prior", F.lit(0)).cast("double")
    has = F.col("month") > F.col("first")
    return joined.select(
        "month", "scope", F.col("holder").alias("cardholder"), F.round(spend, 2).alias("spend_total"),
        F.when(has, F.round(prior, 2)).alias("prior_spend_total"), F.when(has, F.round(spend - prior, 2)).alias("spend_delta"),
        F.when(has & (prior != 0), F.round((spend - prior) / F.nullif(prior, F.lit(0.0)) * 100, 1)).alias("spend_delta_pct"),
        "charge_count", F.round(F.abs(F.coalesce("paid", F.lit(0)).cast("double")), 2).alias("payments_and_refunds"),
        F.round(F.coalesce("open_total", F.lit(0)).cast("double"), 2).alias("uncategorized_total"), F.col("open_count").alias("uncategorized_count"), "review_count",
    )


def pick_month(ledger: DataFrame, month: str | None = None) -> str | None:
    """The month asked for if it looks like one, even if absent; else the latest."""
    if month and len(month) == 7 and month[4] == "-":
        return month
    return ledger.agg(F.max(month_of())).first()[0]


def scoped(ledger: DataFrame, cardholder: str | None = None) -> DataFrame:
    return ledger.where(strip(F.coalesce("cardholder", F.lit(""))) == cardholder.strip()) if cardholder and cardholder.strip() else ledger


def _before(month: str) -> str:
    year, m = int(month[:4]), int(month[5:])
    return f"{year - 1}-12" if m == 1 else f"{year}-{m - 1:02d}"


def month_summary(ledger: DataFrame, month: str | None = None, cardholder: str | None = None) -> DataFrame:
    """The row of one month for one holder, or for the household; zeros for a month without rows. No rows if the ledger is
    empty."""
    chosen = pick_month(ledger, month)
    if chosen is None or ledger.isEmpty():
        return month_summaries(ledger.limit(0))
    name = cardholder.strip() if cardholder and cardholder.strip() else None
    first = F.broadcast(ledger.agg(F.min(month_of()).alias("first")))
    rows = scoped(ledger, name).withColumn("month", month_of()).where(F.col("month").isin(chosen, _before(chosen)))
    now, charge, amount = F.col("month") == chosen, F.col("amount") > 0, F.col("amount")
    open_ = now & charge & blank_or_uncategorized("category")
    spend, prior = (F.coalesce(F.sum(F.when(c & charge, amount)), F.lit(0)).cast("double") for c in (now, ~now))
    found = rows.agg(
        spend.alias("spend"), prior.alias("prior"), F.count_if(now & charge).alias("charge_count"), F.coalesce(F.sum(F.when(now & (amount < 0), amount)), F.lit(0)).cast("double").alias("paid"),
        F.coalesce(F.sum(F.when(open_, amount)), F.lit(0)).cast("double").alias("open_total"), F.count_if(open_).alias("open_count"), F.count_if(now & needs_review()).alias("review_count"),
    ).crossJoin(first)
    has = F.lit(chosen) > F.col("first")
    return found.select(
        F.lit(chosen).alias("month"), F.lit("holder" if name else "household").alias("scope"), F.lit(name).cast("string").alias("cardholder"), F.round("spend", 2).alias("spend_total"),
        F.when(has, F.round("prior", 2)).alias("prior_spend_total"), F.when(has, F.round(F.col("spend") - F.col("prior"), 2)).alias("spend_delta"),
        F.when(has & (F.col("prior") != 0), F.round((F.col("spend") - F.col("prior")) / F.nullif("prior", F.lit(0.0)) * 100, 1)).alias("spend_delta_pct"),
        "charge_count", F.round(F.abs("paid"), 2).alias("payments_and_refunds"), F.round("open_total", 2).alias("uncategorized_total"), F.col("open_count").alias("uncategorized_count"), "review_count",
    )


def month_category_deltas(ledger: DataFrame, month: str | None = None, cardholder: str | None = None) -> DataFrame:
    """(category, total, prior_total, delta) over the categories of a month and the one before."""
    chosen = pick_month(ledger, month) or ""
    first = F.broadcast(ledger.agg(F.min(month_of()).alias("first")))
    name = F.when(blank_or_uncategorized("category"), "Uncategorized").otherwise(F.col("category"))
    rows = charges(scoped(ledger, cardholder)).select(month_of().alias("month"), name.alias("category"), "amount")

    def totals(m: str, as_: str) -> DataFrame:
        return rows.where(F.col("month") == m).groupBy("category").agg(F.sum("amount").cast("double").alias(as_))

    now, then = totals(chosen, "total"), totals(_before(chosen) if chosen else "", "prior_total")
    has = F.lit(chosen) > F.col("first")
    both = now.join(then, "category", "full_outer").crossJoin(first).where(has | F.col("total").isNotNull())
    total, prior = F.coalesce("total", F.lit(0.0)), F.coalesce("prior_total", F.lit(0.0))
    return both.select("category", F.round(total, 2).alias("total"), F.when(has, F.round(prior, 2)).alias("prior_total"), F.when(has, F.round(total - prior, 2)).alias("delta")).orderBy(F.desc("total"), "category")


def month_movers(deltas: DataFrame, n: int = MOVERS) -> DataFrame:
    return deltas.where("delta is not null and delta <> 0").orderBy(F.abs("delta").desc(), "category").limit(n)


def month_holders(ledger: DataFrame, month: str | None = None, cardholder: str | None = None) -> DataFrame:
    """Spend by holder; no rows if one holder is asked for."""
    rows = charges(ledger).where(month_of() == (pick_month(ledger, month) or ""))
    if cardholder and cardholder.strip():
        rows = rows.limit(0)
    return rows.groupBy(F.coalesce(holder(), F.lit(UNASSIGNED)).alias("name")).agg(F.sum("amount").cast("decimal(28,2)").alias("total")).orderBy(F.desc("total"), "name")


def merchant_label(raw: bool = True) -> Column:
    """Canonical, else normalized, else raw text, else Unknown; blanks don't count."""
    names = ["canonical_merchant", "normalized_merchant", *(["raw_description"] if raw else [])]
    return F.coalesce(*[F.when(strip(F.coalesce(c, F.lit(""))) != "", strip(c)) for c in names], F.lit("Unknown"))


def large_charges(ledger: DataFrame, month: str | None = None, cardholder: str | None = None, least: float = LARGE_MIN, n: int = LARGE_MOST) -> DataFrame:
    rows = charges(scoped(ledger, cardholder)).where((month_of() == (pick_month(ledger, month) or "")) & (F.col("amount") >= least))
    return rows.orderBy(F.desc("amount"), "txn_id").limit(n).select("txn_id", "posted_date", merchant_label().alias("merchant"), "amount", F.when(~blank_or_uncategorized("category"), F.col("category")).alias("category"), holder().alias("cardholder"))


def large_charges_by_month(ledger: DataFrame, least: float = LARGE_MIN, n: int = LARGE_MOST) -> DataFrame:
    """The largest charges of every month."""
    order = W.partitionBy("month").orderBy(F.desc("amount"), "txn_id")
    rows = charges(ledger).where(F.col("amount") >= least).withColumn("month", month_of())
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("month", "place", "txn_id", merchant_label().alias("merchant"), "amount")


def tag_spend(ledger: DataFrame, tags: DataFrame, month: str | None = None, cardholder: str | None = None) -> DataFrame:
    """Spend of a month by tag, for trips and occasions."""
    rows = charges(scoped(ledger, cardholder)).where(month_of() == (pick_month(ledger, month) or ""))
    each = rows.select("amount", F.explode(clean_tags("tags")).alias("id"))
    known = F.broadcast(tags.where("kind in ('trip', 'occasion')").select("id", "label", "kind"))
    return each.join(known, "id").groupBy("id", "label", "kind").agg(F.sum("amount").cast("decimal(28,2)").alias("total")).orderBy(F.desc("total"), "id")


def bills_seen(ledger: DataFrame, bills: DataFrame, month: str | None = None) -> DataFrame:
    """(bill, status seen | missing) in a month, whoever paid."""
    rows = charges(ledger).where(month_of() == (pick_month(ledger, month) or ""))
    seen = bill_charges(rows, bills).select("bill_idx").distinct().withColumn("_seen", F.lit(True))
    return bills.join(seen, "bill_idx", "left").select("bill_idx", F.col("name").alias("bill"), F.when(F.coalesce("_seen", F.lit(False)), "seen").otherwise("missing").alias("status"))


def month_facts(view: DataFrame, bills: DataFrame, month: str | None = None, cardholder: str | None = None) -> dict[str, DataFrame]:
    """The overview's tables over the projected view, which has no raw text: without tags, months and review counts."""
    full = view.withColumns({c: F.lit(None).cast("string") for c in ("raw_description", "classified_by", "txn_id") if c not in view.columns})
    deltas = month_category_deltas(full, month, cardholder)
    return {
        "summary": month_summary(full, month, cardholder).drop("review_count"), "categories": deltas, "movers": month_movers(deltas),
        "holders": month_holders(full, month, cardholder), "large_charges": large_charges(full, month, cardholder).drop("txn_id"), "bills": bills_seen(full, bills, month),
    }
