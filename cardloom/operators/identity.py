"""Merchant names, content-hash ids and the multiset reconciliation of overlapping documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import col, plain, squeeze, strip, strip_column
from ..schema import LEDGER, RAW, conform

#: What is noise in a descriptor, payment rails before a merchant's name, US states and the district.
NOISE = r"(?iU)(?:\b\d{4,}\b|#\d+|#\b|\bstore\s*\d+\b|\bloc(?:ation)?\s*\d+\b|\busa\b|\bus\b)"
#: NOISE in upper case, for texts of ASCII alone.
PLAIN_NOISE = r"(?=[#0-9LSU])(?:#(?:\d+|\b)|\b(?:\d{4,}\b|STORE\s*\d+\b|LOC(?:ATION)?\s*\d+\b|USA?\b))"
RAILS = r"(?iU)^(?:APLPAY|APPLE\s+PAY|GPPAY|GOOGLE\s+PAY|PAYPAL|PP|SQ|TST|SP)\b[\s\-*]*"
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI "
    "SC SD TN TX UT VT VA WA WV WI WY DC"
).split()
MERCHANT_WORDS = 6

IDENTITY = ("card", "posted_date", "amount", "raw_description")


def normalize_merchant(raw: Column | str) -> Column:
    """Upper case without noise, its first six words; UNKNOWN if nothing is left."""
    raw = F.coalesce(col(raw), F.lit(""))
    short = F.regexp_replace(F.replace(F.upper(F.trim(raw)), F.lit("*"), F.lit(" ")), PLAIN_NOISE, " ")
    short = F.substring_index(F.trim(F.regexp_replace(short, " {2,}", " ")), " ", MERCHANT_WORDS)
    text = F.regexp_replace(F.upper(strip(raw)), r"\*", " ")
    text = squeeze(F.regexp_replace(text, NOISE, " "))
    text = F.array_join(F.slice(F.split(text, " "), 1, MERCHANT_WORDS), " ")
    return F.regexp_replace(F.when(plain(raw), short).otherwise(text), "^$", "UNKNOWN")


def merchant_identity_key(name: Column | str) -> Column:
    """What tells merchants apart: no payment rail, no city and state at the end. Empty results give the name itself."""
    original = squeeze(F.regexp_replace(F.upper(F.coalesce(col(name), F.lit(""))), r"\*", " "))
    core = original
    for _ in range(2):
        core = strip(F.regexp_replace(core, RAILS, ""))
    words = F.filter(F.split(core, " "), lambda t: t != "")
    in_state = F.coalesce(F.try_element_at(words, F.lit(-1)).isin(STATES), F.lit(False))
    cut = F.when(in_state, F.when(F.size(words) >= 2, 2).otherwise(1)).otherwise(0)
    key = F.array_join(F.slice(words, F.lit(1), F.size(words) - cut), " ")
    return F.when(original == "", "UNKNOWN").when(key == "", original).otherwise(key)


def document_key() -> Column:
    return F.coalesce(F.when(F.col("source_document_id") != "", F.col("source_document_id")), F.concat(F.lit("legacy:"), F.coalesce("source_file", F.lit(""))))


def _identity_text() -> Column:
    """card|date|amount|description: what an id is made of, but for the occurrence."""
    parts = [F.coalesce(F.col(c), F.lit("")) if c == "card" else F.col(c) for c in IDENTITY]
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _occurrences(raw: DataFrame) -> DataFrame:
    """raw with source_occurrence, and with _deal, by which the rows are dealt out."""
    # One exchange serves the occurrences, the reconciliation, the ids and their links: rows whose ids could be equal have equal texts.
    # The sorts of the windows begin with the text's hash, a number that tells nearly all rows apart.
    checked = raw.withColumn("amount", F.when(F.col("amount").isNull(), F.raise_error("a transaction has no amount").cast("decimal(18,2)")).otherwise(F.col("amount")))
    deal = F.xxhash64(_identity_text())
    dealt = checked.withColumn("raw_description", strip_column("raw_description")).repartition(deal).withColumn("_deal", deal)
    order = W.partitionBy("_deal", *IDENTITY, document_key()).orderBy("source_row", "source_file")
    return dealt.withColumn("source_occurrence", (F.row_number().over(order) - 1).cast("bigint"))


def source_occurrence(raw: DataFrame) -> DataFrame:
    """raw with source_occurrence: which of the equal rows of one document this is, from 0, by source_row. A row without
    amount fails the job."""
    return _occurrences(raw).drop("_deal")


def txn_id() -> Column:
    """First 16 hex digits of the SHA-256 of card|date|amount|description|occurrence."""
    text = F.concat_ws("|", _identity_text(), F.coalesce(F.col("source_occurrence").cast("string"), F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 16)


def with_ids(raw: DataFrame) -> DataFrame:
    return source_occurrence(raw).withColumn("txn_id", txn_id())


def assign_transaction_ids(raw: DataFrame) -> DataFrame:
    """One row for each id, which is one for each identity and occurrence: documents that overlap count their largest
    multiplicity, not the sum. The row of the smallest document id (none first), then source_row, stays."""
    best = W.partitionBy("_deal", "txn_id").orderBy(F.coalesce("source_document_id", F.lit("")), "source_row", F.coalesce("source_file", F.lit("")))
    rows = _occurrences(raw).withColumn("txn_id", txn_id())
    return rows.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place", "_deal")


def transaction_sources(raw: DataFrame) -> DataFrame:
    """Every distinct link of a transaction to a document and row."""
    links = _occurrences(raw).select("_deal", txn_id().alias("txn_id"), "source_document_id", "source_file", "source_row", "source_occurrence")
    return links.distinct().drop("_deal")


def normalize(raw: DataFrame) -> DataFrame:
    """Raw transactions as new ledger rows: reconciled, with ids and normalized merchants."""
    rows = assign_transaction_ids(conform(raw, RAW)).withColumns({"normalized_merchant": normalize_merchant("raw_description"), "merchant_source": F.lit("none"), "tags": F.array().cast("array<string>")})
    return conform(rows, LEDGER)
