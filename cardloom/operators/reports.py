"""Aggregates and reports over the ledger. Spend is positive; payments and refunds are negative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .classify import classification_counts, needs_review


def month_of(date: str = "posted_date") -> Column:
    return F.date_format(date, "yyyy-MM")


def _money(c: Column | str) -> Column:
    return F.sum(c).cast("decimal(28,2)")


def charges(ledger: DataFrame) -> DataFrame:
    return ledger.where("amount > 0")


def category_monthly(ledger: DataFrame) -> DataFrame:
    """(month, category, subcategory, total, txn_count) of charges."""
    keys = [month_of().alias("month"), F.coalesce("category", F.lit("Uncategorized")).alias("category"), F.coalesce("subcategory", F.lit("")).alias("subcategory")]
    return charges(ledger).groupBy(*keys).agg(_money("amount").alias("total"), F.count("*").alias("txn_count")).orderBy("month", "category", "subcategory")


def category_monthly_totals(ledger: DataFrame) -> DataFrame:
    keys = [month_of().alias("month"), F.coalesce("category", F.lit("Uncategorized")).alias("category")]
    return charges(ledger).groupBy(*keys).agg(_money("amount").alias("total"), F.count("*").alias("txn_count")).orderBy("month", "category")


def merchant_monthly(ledger: DataFrame) -> DataFrame:
    """(month, merchant, is_canonical, total, txn_count) of charges, the largest of a month first."""
    keys = [month_of().alias("month"), F.coalesce("canonical_merchant", "normalized_merchant").alias("merchant"), F.col("canonical_merchant").isNotNull().alias("is_canonical")]
    return charges(ledger).groupBy(*keys).agg(_money("amount").alias("total"), F.count("*").alias("txn_count")).orderBy("month", F.desc("total"), "merchant")


def merchant_totals(ledger: DataFrame) -> DataFrame:
    keys = [F.coalesce("canonical_merchant", "normalized_merchant").alias("merchant"), F.col("canonical_merchant").isNotNull().alias("is_canonical")]
    return charges(ledger).groupBy(*keys).agg(_money("amount").alias("total"), F.count("*").alias("txn_count")).orderBy(F.desc("total"), "merchant")


def category_totals(ledger: DataFrame) -> DataFrame:
    """All-time spend by category, the largest first."""
    monthly = category_monthly_totals(ledger)
    return monthly.groupBy("category").agg(_money("total").alias("total"), F.sum("txn_count").alias("txn_count")).orderBy(F.desc("total"), "category")


def category_trend(ledger: DataFrame, category: str | None = None) -> DataFrame:
    """(month, category, total) of one category, of the biggest if none is named."""
    monthly = category_monthly_totals(ledger)
    if category is not None:
        return monthly.where(F.col("category") == category).select("month", "category", "total").orderBy("month")
    top = category_totals(ledger).limit(1).select("category")
    return monthly.join(F.broadcast(top), "category", "left_semi").select("month", "category", "total").orderBy("month")


def ledger_summary(ledger: DataFrame, recurring: DataFrame) -> DataFrame:
    counts = ledger.agg(
        F.count("*").alias("txn_count"),
        F.count_if(uncategorized_for_export()).alias("uncategorized_count"),
        F.count("canonical_merchant").alias("canonical_count"),
        F.count_distinct(F.when(F.col("canonical_merchant").isNull(), F.col("normalized_merchant"))).alias("unknown_merchant_count"),
    )
    return counts.crossJoin(F.broadcast(recurring.agg(F.count_if("is_recurring").alias("recurring_count"))))


def status_counts(ledger: DataFrame) -> DataFrame:
    more = ledger.agg(
        F.count("canonical_merchant").alias("canonical"),
        F.count_distinct(F.when(F.col("canonical_merchant").isNull(), F.col("normalized_merchant"))).alias("unknown_merchants"),
        F.count_if(needs_review()).alias("review_pending"),
        F.count_distinct(F.when(strip("cardholder") != "", strip("cardholder"))).alias("cardholders"),
    )
    return classification_counts(ledger).crossJoin(F.broadcast(more))


def cardholders(ledger: DataFrame) -> DataFrame:
    return ledger.select(strip("cardholder").alias("cardholder")).where("cardholder <> ''").distinct().orderBy("cardholder")


def facets(df: DataFrame) -> DataFrame:
    """(facet, value): the cards and categories that occur."""
    each = F.explode(F.array(F.struct(F.lit("card").alias("facet"), F.col("card").alias("value")), F.struct(F.lit("category").alias("facet"), F.coalesce("category", F.lit("Uncategorized")).alias("value"))))
    return df.select(each.alias("f")).select("f.facet", "f.value").where("value is not null").distinct().orderBy("facet", "value")


def uncategorized_for_export() -> Column:
    by = F.col("classified_by")
    return by.isNull() | F.col("category").isNull() | (F.col("category") == "Uncategorized") | (by == "ai")


def export_uncategorized(ledger: DataFrame) -> DataFrame:
    return ledger.where(uncategorized_for_export())


def redact_recurring(df: DataFrame, include_names: bool = False) -> DataFrame:
    return df if include_names else df.withColumn("normalized_merchant", F.lit("Recurring merchant"))


def redact_reconciliation(df: DataFrame, include_names: bool = False) -> DataFrame:
    return df if include_names else df.withColumns({"matched_merchant": F.lit(None).cast("string"), "bill": F.lit("Expected bill")})


def publish_ledger(ledger: DataFrame) -> DataFrame:
    return ledger.drop("source_file", "source_document_id")


def exports(ledger: DataFrame, recurring: DataFrame, reconciliation: DataFrame, mode: str = "aggregates", include_names: bool = False) -> dict[str, DataFrame]:
    """The artefacts that may leave, by name: aggregates always, merchants by name only if asked, rows only in full mode."""
    out = {
        "category_monthly": category_monthly(ledger),
        "summary": ledger_summary(ledger, recurring),
        "recurring": redact_recurring(recurring, include_names),
        "reconciliation": redact_reconciliation(reconciliation, include_names),
    }
    if include_names:
        out["merchant_totals"] = merchant_totals(ledger)
    if mode == "full":
        out |= {"ledger": publish_ledger(ledger), "uncategorized": publish_ledger(export_uncategorized(ledger))}
    return out
