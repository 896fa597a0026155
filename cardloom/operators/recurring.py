"""Recurring merchants and reconciliation with expected bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .matching import java_pattern, valid_patterns
from .reports import charges


def recurring(ledger: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """Merchants charged at least so often: number, mean, population deviation, median gap in days, whether the amount is
    stable (deviation under a quarter of the mean) and monthly (median gap 25 to 40) or seen three times, and the most
    frequent category (of equal ones the lowest).

    Days are first counted by merchant and date, so a merchant with very many charges sends a row a day and task."""
    spend = charges(ledger)
    value = F.col("amount").cast("double")
    by_day = spend.groupBy("normalized_merchant", "posted_date").agg(F.count("*").alias("n"), F.sum("amount").alias("sum"), F.sum(value * value).alias("squares"))
    before = W.partitionBy("normalized_merchant").orderBy("posted_date")
    gap = F.datediff("posted_date", F.lag("posted_date").over(before))
    # A day's further charges are gaps of no days.
    gaps = by_day.withColumn("gaps", F.array(F.struct(gap.alias("days"), F.lit(1).cast("bigint").alias("n")), F.struct(F.lit(0).alias("days"), (F.col("n") - 1).alias("n"))))
    each = gaps.select("normalized_merchant", F.explode("gaps").alias("g")).where("g.days is not null and g.n > 0").groupBy("normalized_merchant", "g.days").agg(F.sum("g.n").alias("n"))
    median = each.groupBy("normalized_merchant").agg(F.expr("percentile(days, 0.5, n)").alias("gap"))
    whole = by_day.groupBy("normalized_merchant").agg(F.sum("n").alias("occurrences"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"))
    # Squares of deviations from the mean, so that equal amounts deviate by exactly nothing.
    mean = whole.select("normalized_merchant", "occurrences", (F.col("sum").cast("double") / F.col("occurrences")).alias("avg"))
    amounts = spend.groupBy("normalized_merchant", "amount").agg(F.count("*").alias("n")).join(mean, "normalized_merchant")
    off = F.col("amount").cast("double") - F.col("avg")
    spread = amounts.groupBy("normalized_merchant").agg(F.first("occurrences").alias("occurrences"), F.first("avg").alias("avg"), F.sqrt(F.sum(off * off * F.col("n")) / F.first("occurrences")).alias("std"))

    def most(column: str) -> DataFrame:
        counted = spend.where(F.col(column).isNotNull()).groupBy("normalized_merchant", column).agg(F.count("*").alias("n"))
        return counted.groupBy("normalized_merchant").agg(F.min(F.struct((-F.col("n")).alias("back"), column)).alias("m")).select("normalized_merchant", F.col(f"m.{column}").alias(column))

    joined = spread.where(F.col("occurrences") >= min_occurrences).join(median, "normalized_merchant", "left").join(most("category"), "normalized_merchant", "left").join(most("subcategory"), "normalized_merchant", "left")
    stable = F.col("std") / F.col("avg") < 0.25
    monthly = F.coalesce(F.col("gap").between(25, 40), F.lit(False))
    return joined.select(
        "normalized_merchant", "occurrences", F.round("avg", 2).alias("avg_amount"), F.round("std", 2).alias("std_amount"), F.round("gap", 1).alias("median_gap_days"),
        (stable & (monthly | (F.col("occurrences") >= 3))).alias("is_recurring"), "category", "subcategory",
    ).orderBy(F.desc("is_recurring"), F.desc("avg_amount"), "normalized_merchant")


def recurring_only(df: DataFrame) -> DataFrame:
    return df.where("is_recurring")


def _patterns(bills: DataFrame) -> Column:
    """The bills' patterns as one array; bills are a list curated by hand."""
    rows = [r for r in valid_patterns(bills, "merchant_regex") if r["merchant_regex"]]
    each = [F.struct(F.lit(r["bill_idx"]).alias("bill_idx"), F.lit(java_pattern(r["merchant_regex"])).alias("p")) for r in rows]
    return F.array(*each or [F.struct(F.lit(-1).alias("bill_idx"), F.lit("(?!)").alias("p"))])


def _billed(rows: DataFrame, bills: DataFrame) -> DataFrame:
    """rows with bill_idx, once for each bill whose pattern is found in the normalized or raw text; one pass for all bills."""
    name, raw = F.coalesce("normalized_merchant", F.lit("")), F.coalesce("raw_description", F.lit(""))
    hit = F.explode(F.filter(_patterns(bills), lambda b: F.rlike(name, b["p"]) | F.rlike(raw, b["p"])))
    return rows.withColumn("_hit", hit).withColumn("bill_idx", F.col("_hit.bill_idx")).drop("_hit")


def bill_charges(ledger: DataFrame, bills: DataFrame) -> DataFrame:
    """Charges with bill_idx: a row for each bill whose pattern is found in the normalized or raw text."""
    return _billed(charges(ledger), bills)


def reconcile_bills(ledger: DataFrame, bills: DataFrame) -> DataFrame:
    """(bill, status, expected_amount, matched_merchant, matched_avg, last_seen) of each bill (bill_idx, name,
    merchant_regex, expected_amount): missing, matched, or amount_mismatch if the mean is off by over 5 and over a tenth.
    An empty ledger gives no rows."""
    # Totals by descriptor and day first: patterns run once for each, and days are summed before they meet.
    spend = charges(ledger).groupBy("normalized_merchant", "raw_description").agg(F.sum("amount").alias("sum"), F.count("*").alias("n"), F.max("posted_date").alias("last"))
    hits = _billed(spend, bills)
    names = hits.groupBy("bill_idx", "normalized_merchant").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.max("last").alias("last"))
    seen = names.groupBy("bill_idx").agg(
        (F.sum("sum").cast("double") / F.sum("n")).alias("avg"), F.max("last").alias("last"), F.min(F.struct((-F.col("n")).alias("back"), "normalized_merchant")).alias("m")
    )
    expected = F.col("expected_amount").cast("double")
    off = F.abs(F.col("avg") - expected) > F.greatest(F.lit(5.0), 0.1 * expected)
    some = F.broadcast(ledger.limit(1).select(F.lit(1).alias("_some")))
    return F.broadcast(bills).join(seen, "bill_idx", "left").crossJoin(some).select(
        "bill_idx", F.col("name").alias("bill"),
        F.when(F.col("avg").isNull(), "missing").when(F.coalesce(off, F.lit(False)), "amount_mismatch").otherwise("matched").alias("status"),
        expected.alias("expected_amount"), F.col("m.normalized_merchant").alias("matched_merchant"), F.round("avg", 2).alias("matched_avg"), F.date_format("last", "yyyy-MM-dd").alias("last_seen"),
    )
