"""Statement coverage by card product: statistics, gaps, staleness."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import label

UNASSIGNED = "Unassigned"
GAP_DAYS, STALE_DAYS = 14, 40


def product_key() -> dict[str, Column]:
    issuer, product = label("card_issuer"), label("card_product")
    neither = (issuer == "") & (product == "")
    return {
        "issuer": F.when(neither, "").when(issuer == "", "Unknown").otherwise(issuer),
        "product": F.when(product == "", UNASSIGNED).otherwise(product),
        "holder": F.when(label("cardholder") == "", UNASSIGNED).otherwise(label("cardholder")),
    }


def statement_stats(ledger: DataFrame) -> DataFrame:
    """One row for each product, holder and document: counts, spend, payments, what is uncategorized, first and last day."""
    document, file = label("source_document_id"), label("source_file")
    document = F.when(document != "", document).when(file != "", file).otherwise("unknown")
    name = F.when(file != "", F.element_at(F.split(F.regexp_replace(file, "/+$", ""), "/"), -1)).otherwise("Unknown statement")
    charge, amount = F.col("amount") > 0, F.col("amount")
    open_ = charge & label("category").isin("", "Uncategorized")
    money = lambda c: F.coalesce(F.sum(F.when(c, amount)), F.lit(0)).cast("decimal(28,2)")
    return ledger.withColumns(product_key() | {"document": document, "file_name": name}).groupBy("issuer", "product", "holder", "document").agg(
        F.min("file_name").alias("file_name"), F.count("*").alias("txn_count"), F.count_if(charge).alias("charge_count"), money(charge).alias("spend_total"),
        F.abs(money(amount < 0)).alias("payments_and_refunds"), F.count_if(open_).alias("uncategorized_count"), money(open_).alias("uncategorized_total"),
        F.min("posted_date").alias("coverage_start"), F.max("posted_date").alias("coverage_end"),
    )


def coverage_gaps(statements: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """(issuer, product, holder, after, before, days) between statements that follow one another by start and end."""
    order = W.partitionBy("issuer", "product", "holder").orderBy("coverage_start", "coverage_end", "document")
    rows = statements.where("coverage_start is not null and coverage_end is not null").withColumn("after", F.lag("coverage_end").over(order))
    days = F.datediff("coverage_start", "after")
    return rows.withColumn("days", days).where(F.col("days") > gap_days).select("issuer", "product", "holder", "after", F.col("coverage_start").alias("before"), "days")


def cards_coverage(ledger: DataFrame, products: DataFrame, today: date, stale_days: int = STALE_DAYS, gap_days: int = GAP_DAYS) -> DataFrame:
    """One row a product and holder with totals, statements, gaps and status: none (of `products` (issuer, product) never
    seen), gap, stale (the last day is older than `stale_days`) or ok."""
    keys = ["issuer", "product", "holder"]
    statements = statement_stats(ledger)
    each = F.struct("coverage_start", "file_name", F.col("document").alias("id"), "txn_count", "spend_total", "payments_and_refunds", "coverage_end")
    totals = statements.groupBy(*keys).agg(
        F.count("*").alias("statement_count"), *[F.sum(c).alias(c) for c in ("txn_count", "charge_count", "spend_total", "payments_and_refunds", "uncategorized_count", "uncategorized_total")],
        F.min("coverage_start").alias("coverage_start"), F.max("coverage_end").alias("coverage_end"), F.array_sort(F.collect_list(each)).alias("statements"),
    )
    gaps = coverage_gaps(statements, gap_days).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("after", "before", "days"))).alias("gaps"))
    age = F.datediff(F.lit(today), "coverage_end")
    seen = totals.join(gaps, keys, "left").withColumn("stale_days", F.when(age > stale_days, age))
    status = F.when(F.size(F.coalesce("gaps", F.array())) > 0, "gap").when(F.col("stale_days").isNotNull(), "stale").otherwise("ok")
    seen = seen.withColumn("status", status)
    named = products.select("issuer", label("product").alias("product")).where("product <> ''").distinct()
    never = named.join(seen.select("issuer", "product").distinct(), ["issuer", "product"], "left_anti").withColumns({"holder": F.lit(""), "status": F.lit("none"), "statement_count": F.lit(0).cast("bigint")})
    base = F.trim(F.concat_ws(" ", "issuer", "product"))
    title = F.when(F.col("holder") == "", base).otherwise(F.concat(base, F.lit(" · "), F.col("holder")))
    both = seen.unionByName(never, allowMissingColumns=True).withColumn("label", title)
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("txn_count", "charge_count", "spend_total", "payments_and_refunds", "uncategorized_count", "uncategorized_total")}
    return both.withColumns(zeros).orderBy(*keys)


def select_product(coverage: DataFrame, issuer: str | None = None, product: str | None = None, holder: str | None = None) -> DataFrame:
    """The first row that fits what is asked for."""
    for c, want in (("issuer", issuer), ("product", product), ("holder", holder)):
        if want and want.strip():
            coverage = coverage.where(F.col(c) == want.strip())
    return coverage.orderBy("issuer", "product", "holder").limit(1)
