"""Ledger search and spend questions over an allow-listed view of the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import col, is_blank, label, strip
from .classify import clean_tags, needs_review
from .overview import merchant_label

VIEW = ("posted_date", "amount", "canonical_merchant", "normalized_merchant", "category", "card", "card_issuer", "card_product", "cardholder", "tags")
NAMES, SAMPLES = 12, 15


def search_ledger(
    ledger: DataFrame, q: str | None = None, category: str | None = None, tag: str | None = None, card: str | None = None, merchant: str | None = None,
    unclassified: bool = False, limit: int = 200, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The page of matching rows, newest first, and how many match in all. q is looked for as it is, case apart."""
    rows = ledger
    if q and q.strip():
        text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("raw_description", "normalized_merchant", "canonical_merchant")]))
        rows = rows.where(F.contains(text, F.lit(q.strip().lower())))
    if category:
        rows = rows.where(F.coalesce("category", F.lit("Uncategorized")) == category)
    if tag:
        rows = rows.where(F.array_contains(clean_tags("tags"), tag))
    if card:
        rows = rows.where(F.col("card") == card)
    if merchant:
        rows = rows.where((F.coalesce("canonical_merchant", F.lit("")) == merchant) | (F.coalesce("normalized_merchant", F.lit("")) == merchant))
    if unclassified:
        rows = rows.where(needs_review())
    return rows.orderBy(F.desc("posted_date"), "txn_id").offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))


def project_ledger_view(ledger: DataFrame) -> DataFrame:
    """The ten columns that questions may see."""
    return ledger.select(*[F.col(c) if c in ledger.columns else F.lit(None).cast("array<string>" if c == "tags" else "string").alias(c) for c in VIEW])


def window_filter(df: DataFrame, since: str | None = None, until: str | None = None, cardholder: str | None = None) -> DataFrame:
    """Rows with a date inside the inclusive bounds, of one holder if named."""
    rows = df.where("posted_date is not null")
    if since:
        rows = rows.where(F.col("posted_date") >= F.lit(since).cast("date"))
    if until:
        rows = rows.where(F.col("posted_date") <= F.lit(until).cast("date"))
    return rows.where(strip(F.coalesce("cardholder", F.lit(""))) == cardholder) if cardholder else rows


def ledger_snapshot(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("txn_count"), F.min("posted_date").alias("first_posted"), F.max("posted_date").alias("last_posted"),
        F.array_join(F.array_sort(F.collect_set(F.when(strip("cardholder") != "", strip("cardholder")))), ",").alias("cardholders"),
    )


def snapshot_products(df: DataFrame) -> DataFrame:
    """(card_issuer, card_product, cardholder, last_posted, txn_count) of dated rows; blank keys are null and kept."""
    keys = [F.when(~is_blank(c), strip(c)).alias(c) for c in ("card_issuer", "card_product", "cardholder")]
    return df.where("posted_date is not null").groupBy(*keys).agg(F.max("posted_date").alias("last_posted"), F.count("*").alias("txn_count")).orderBy("last_posted", "card_issuer", "card_product", "cardholder")


def merchant_matches(query: str) -> Column:
    hit = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower()))
    return hit("canonical_merchant") | hit("normalized_merchant")


def _spend() -> list[Column]:
    amount = F.col("amount")
    gross = F.round(F.coalesce(F.sum(F.when(amount > 0, amount)), F.lit(0)).cast("double"), 2)
    credits = F.round(F.abs(F.coalesce(F.sum(F.when(amount < 0, amount)), F.lit(0)).cast("double")), 2)
    return [
        gross.alias("gross_charges"), credits.alias("credits_refunds"), F.round(gross - credits, 2).alias("net_spend"),
        F.count_if(amount > 0).alias("charge_count"), F.count_if(amount < 0).alias("credit_count"),
        F.min("posted_date").alias("first_posted"), F.max("posted_date").alias("last_posted"),
    ]


def merchant_spend(df: DataFrame, query: str, since: str | None = None, until: str | None = None, cardholder: str | None = None) -> DataFrame:
    """Gross, credits and net of rows whose names contain the query; ambiguous if they are of several names."""
    rows = window_filter(df, since, until, cardholder).where(merchant_matches(query))
    return rows.agg(*_spend(), (F.count_distinct(merchant_label(raw=False)) > 1).alias("ambiguous"))


def matched_names(df: DataFrame, query: str, n: int = NAMES) -> DataFrame:
    """The n names with the largest gross among the matches, and a row `+k more` for the others."""
    amount = F.col("amount")
    money = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)).cast("double"), 2)
    names = df.where(merchant_matches(query)).groupBy(merchant_label(raw=False).alias("name")).agg(money(F.when(amount > 0, amount)).alias("gross_charges"), money(amount).alias("net_spend"), F.count_if(amount > 0).alias("charge_count"))
    top = names.orderBy(F.desc("gross_charges"), "name").limit(n).withColumn("place", F.row_number().over(W.orderBy(F.desc("gross_charges"), "name")))
    rest = names.agg(F.count("*").alias("all")).where(F.col("all") > n)
    more = rest.select(F.concat(F.lit("+"), (F.col("all") - n).cast("string"), F.lit(" more")).alias("name"), F.lit(0.0).alias("gross_charges"), F.lit(0.0).alias("net_spend"), F.lit(0).cast("bigint").alias("charge_count"), F.lit(n + 1).alias("place"))
    return top.unionByName(more)


def category_spend(df: DataFrame, category: str, since: str | None = None, until: str | None = None, cardholder: str | None = None) -> DataFrame:
    """Spend of the category, case apart; only if no row has it, of categories that contain it."""
    name, want = F.lower(F.coalesce("category", F.lit(""))), category.lower()
    rows = window_filter(df, since, until, cardholder).where(F.contains(name, F.lit(want))).withColumn("exact", name == want)
    by = rows.groupBy("exact").agg(F.struct(*_spend()).alias("s"))
    chosen = by.orderBy(F.desc("exact")).limit(1).select("s.*")
    empty = df.limit(0).agg(*_spend())
    return chosen.unionByName(empty.join(F.broadcast(chosen.select(F.lit(1).alias("_some"))), F.lit(True), "left_anti"))


def search_transactions(df: DataFrame, q: str | None = None, category: str | None = None, since: str | None = None, until: str | None = None, cardholder: str | None = None, limit: int = SAMPLES) -> tuple[DataFrame, DataFrame]:
    """(match_count, charge_count, gross_charges, period), and the largest charges as samples, or if none the largest rows."""
    rows = window_filter(df, since, until, cardholder)
    if category:
        rows = rows.where(F.lower(F.coalesce("category", F.lit(""))) == category.lower())
    if q:
        rows = rows.where(merchant_matches(q))
    counts = rows.agg(F.count("*").alias("match_count"), *[c for i, c in enumerate(_spend()) if i in (0, 3, 5, 6)])
    charge = F.col("amount") > 0
    # Charges come first by amount, so other rows among the first show only where there are no charges at all.
    top = rows.orderBy(F.desc("amount"), "posted_date", "normalized_merchant").limit(limit)
    some = F.max(charge).over(W.partitionBy())
    samples = top.withColumn("_some", some).where(charge | ~F.col("_some")).select("posted_date", merchant_label(raw=False).alias("merchant"), "amount", F.when(~is_blank("category"), F.col("category")).alias("category"), F.when(~is_blank("cardholder"), strip("cardholder")).alias("cardholder"))
    return counts, samples


def period(df: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """(since, until, first_posted, last_posted): the bounds asked for, else those seen."""
    first, last = F.date_format(F.min("posted_date"), "yyyy-MM-dd"), F.date_format(F.max("posted_date"), "yyyy-MM-dd")
    return df.agg(F.coalesce(F.lit(since), first).alias("since"), F.coalesce(F.lit(until), last).alias("until"), F.coalesce(first, F.lit(since)).alias("first_posted"), F.coalesce(last, F.lit(until)).alias("last_posted"))


def _numbers(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), group)
    return F.filter(F.transform(found, lambda t: F.round(F.regexp_replace(t, ",", "").try_cast("double"), 2)), lambda n: n.isNotNull())


def grounded_replies(replies: DataFrame, reply: str = "reply", facts: str = "facts_json") -> DataFrame:
    """replies with `grounded`: whether each number of the reply (amounts in dollars, numbers of two digits or with a
    fraction; whole ones from 0 to 31 don't count, years do) is within 0.015 of a number in its facts."""
    known = _numbers(F.regexp_replace(F.coalesce(col(facts), F.lit("")), r"(?<=\d),(?=\d{3})", ""), r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)")
    dollars = _numbers(col(reply), r"\$\s?(-?\d[\d,]*(?:\.\d+)?)")
    bare = _numbers(col(reply), r"(?<![\w$.,])(\d{2,}(?:,\d{3})*(?:\.\d+)?|\d+\.\d+)(?![\w])")
    bare = F.filter(bare, lambda n: ~((n == F.floor(n)) & n.between(0, 31)))
    said = F.concat(dollars, bare)
    return replies.withColumn("grounded", F.forall(said, lambda n: F.exists(known, lambda k: F.abs(n - k) < 0.015)))
