"""A ledger derived from the TPC-H-like tables, as SQL that Spark and DuckDB both accept, and dictionaries for it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import classify_rows
from ..operators.identity import normalize
from ..tables import kept, shared_folder, written

RAW_SQL = """
WITH base AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, o.o_custkey, c.c_mktsegment, CAST(l.l_shipdate AS DATE) AS posted_date,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END * FLOOR(l.l_extendedprice) / 100.0 AS DECIMAL(18,2)) AS amount,
         CASE p.p_partkey % 12
           WHEN 0 THEN 'WAL-MART #' || CAST(1000 + l.l_suppkey AS STRING) || ' ATLANTA GA'
           WHEN 1 THEN 'AMZN MKTP US*' || CAST(l.l_suppkey AS STRING)
           WHEN 2 THEN 'STARBUCKS STORE ' || CAST(10000 + l.l_suppkey AS STRING)
           WHEN 3 THEN 'SHELL OIL ' || CAST(570000000 + l.l_suppkey AS STRING)
           WHEN 4 THEN 'UBER EATS 8005928996 CA'
           WHEN 5 THEN 'UBER TRIP HELP.UBER.COM'
           WHEN 6 THEN 'APLPAY ORCA SEATTLE WA'
           ELSE upper(p.p_name) || ' LOC ' || CAST(l.l_suppkey AS STRING) || ' ' || replace(n.n_name, '_', ' ') END AS raw_description
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey),
lines AS (
  SELECT 'card-' || CAST(o_custkey % 20 AS STRING) AS card, c_mktsegment AS card_issuer,
         CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'Product ' || CAST(o_custkey % 3 AS STRING) END AS card_product,
         CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'Holder ' || CAST(o_custkey % 4 AS STRING) END AS cardholder,
         posted_date, amount, raw_description, o_custkey, l_orderkey, l_orderkey * 10 + l_linenumber AS line FROM base),
docs AS (SELECT *, 'doc-' || card || '-' || CAST(year(posted_date) * 100 + month(posted_date) AS STRING) AS doc FROM lines)
SELECT card, card_issuer, card_product, cardholder, posted_date, amount, raw_description, doc AS source_document_id, line AS source_row FROM docs
UNION ALL
SELECT card, card_issuer, card_product, cardholder, posted_date, amount, raw_description, 'overlap-' || card, line FROM docs WHERE l_orderkey % 10 = 0
UNION ALL
SELECT card, card_issuer, card_product, cardholder, posted_date, amount, raw_description, doc, line + 1000000000 FROM docs WHERE l_orderkey % 25 = 0
UNION ALL
SELECT 'card-' || CAST(s.s_suppkey % 20 AS STRING), 'BUILDING', 'Product 0', 'Holder 1', make_date(2000, m.n_nationkey + 1, 15),
       CAST(FLOOR(abs(s.s_acctbal)) / 100.0 AS DECIMAL(18,2)), 'SUBSCRIPTION ' || CAST(s.s_suppkey AS STRING), 'sub-' || CAST(s.s_suppkey AS STRING), CAST(m.n_nationkey AS BIGINT)
FROM supplier s CROSS JOIN nation m WHERE m.n_nationkey < 12
"""
TABLES = ("lineitem", "orders", "customer", "nation", "part", "supplier")

#: (entry_idx, canonical, kind, pattern, category, subcategory); no look-ahead, which one of the two engines lacks.
ALIASES = [
    (0, "Walmart", "regex", r"(?i)wal[-\s]?mart", "Shopping", "Retail"),
    (1, "Amazon", "regex", r"(?i)amazon|\bamzn\b", "Shopping", "Retail"),
    (2, "Starbucks", "regex", r"(?i)\bstarbucks\b", "Food", "Coffee"),
    (3, "Shell", "regex", r"(?i)\bshell oil\b", None, None),
    (4, "Uber Eats", "exact", "UBER EATS CA", "Food", "Restaurant"),
    (5, "Uber", "regex", r"(?i)\buber\b", None, None),
]
RULES = [
    (0, "regex", r"(?i)shell|exxon|chevron", "Transport", "Gas"),
    (1, "canonical", "uber", "Transport", "Rideshare"),
    (2, "exact", "APLPAY ORCA SEATTLE WA", "Travel", "Transit"),
    (3, "regex", r"(?i)^subscription \d", "Subscriptions", "Streaming"),
]
BILLS = [(0, "Gas", r"(?i)shell oil", 250.0), (1, "Club", r"(?i)subscription 1\b", 1.0), (2, "Rent", r"(?i)rocket mortgage", None), (3, "Empty", None, 10.0), (4, "Trains", r"(?i)\borca\b", None)]
TAGS = [("gift", "Gift", "occasion"), ("beach", "Beach", "trip"), ("work", "Work", "other")]
PRODUCTS = [("BUILDING", "Product 0"), ("BUILDING", "Product 9"), ("AUTOMOBILE", "Product 1"), ("Bank", "Gold")]
CATEGORIES = ["Shopping", "Food", "Transport", "Travel", "Subscriptions", "Other"]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(re.sub(r"\b(lineitem|orders|customer|nation|part|supplier)\b", r"{\1}", RAW_SQL), **frames).withColumn("source_file", F.concat(F.lit("inbox/"), "source_document_id", F.lit(".csv")))


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "entry_idx int, canonical string, kind string, pattern string, category string, subcategory string")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_idx int, kind string, pattern string, category string, subcategory string")


def bills(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BILLS, "bill_idx int, name string, merchant_regex string, expected_amount double")


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAGS, "id string, label string, kind string")


def products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRODUCTS, "issuer string, product string")


_stored: dict[tuple[str, str], str] = {}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciled, canonicalized and classified; tags and hand-made classifications follow from the occurrence and id.

    The ledger is built once for each application and folder and kept as Parquet in the shared folder, as a job would keep it
    in its store; the queries read it from there."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stored:
        path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
        # Each step's shuffle files go before the next begins.
        written(marked(classify_rows(normalize(kept(raw(spark, sf_dir))), aliases(spark), rules(spark))), path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def marked(rows: DataFrame) -> DataFrame:
    tag = F.when(F.col("txn_id") < "2", F.array(F.lit("gift"))).when(F.col("txn_id") < "4", F.array(F.lit("beach"), F.lit("work"))).otherwise(F.array().cast("array<string>"))
    ai = F.col("category").isNull() & (F.substring("txn_id", 1, 1) == "f")
    return rows.withColumns({"tags": tag, "classified_by": F.when(ai, "ai").otherwise(F.col("classified_by")), "category": F.when(ai, "Other").otherwise(F.col("category"))})


def _values(rows: list) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


NORMAL = r"""regexp_replace(replace(upper(trim(raw_description)), '*', ' '), '(\b\d{4,}\b|#\d+|#\b|\bstore\s*\d+\b|\bloc(?:ation)?\s*\d+\b|\busa\b|\bus\b)', ' ', 'gi')"""

#: Common table expressions that end in `ledger`, as DuckDB reads them.
LEDGER_CTE = rf"""
WITH raw AS ({RAW_SQL}),
occ AS (SELECT *, row_number() OVER (PARTITION BY card, posted_date, amount, trim(raw_description), source_document_id ORDER BY source_row) - 1 AS source_occurrence FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY card, posted_date, amount, trim(raw_description), source_occurrence ORDER BY source_document_id, source_row) AS place FROM occ),
ids AS (SELECT * REPLACE (trim(raw_description) AS raw_description), substring(sha256(card || '|' || CAST(posted_date AS VARCHAR) || '|' || CAST(amount AS VARCHAR) || '|' || trim(raw_description) || '|' || CAST(source_occurrence AS VARCHAR)), 1, 16) AS txn_id FROM placed WHERE place = 1),
words AS (SELECT *, trim(regexp_replace({NORMAL}, '\s+', ' ', 'g')) AS w FROM ids),
named AS (SELECT * EXCLUDE (w, place), CASE WHEN w = '' THEN 'UNKNOWN' ELSE array_to_string(list_slice(string_split(w, ' '), 1, 6), ' ') END AS normalized_merchant FROM words),
aliases(entry_idx, canonical, kind, pattern, category, subcategory) AS (VALUES {_values(ALIASES)}),
rules(rule_idx, kind, pattern, category, subcategory) AS (VALUES {_values(RULES)}),
bills(bill_idx, name, merchant_regex, expected_amount) AS (VALUES {_values(BILLS)}),
tagnames(id, label, kind) AS (VALUES {_values(TAGS)}),
products(issuer, product) AS (VALUES {_values(PRODUCTS)}),
descr AS (SELECT DISTINCT normalized_merchant, raw_description FROM named),
alias_hit AS (SELECT normalized_merchant, raw_description, min(entry_idx) AS entry_idx FROM descr JOIN aliases ON CASE WHEN kind = 'exact' THEN upper(normalized_merchant) = upper(pattern) ELSE regexp_matches(normalized_merchant, pattern) OR regexp_matches(raw_description, pattern) END GROUP BY 1, 2),
canon AS (SELECT n.*, a.canonical AS canonical_merchant, CASE WHEN a.canonical IS NULL THEN 'none' ELSE 'alias' END AS merchant_source, a.category AS dcat, a.subcategory AS dsub
          FROM named n LEFT JOIN alias_hit h USING (normalized_merchant, raw_description) LEFT JOIN aliases a USING (entry_idx)),
rule_hit AS (SELECT canonical_merchant, normalized_merchant, raw_description, min(rule_idx) AS rule_idx
             FROM (SELECT DISTINCT canonical_merchant, normalized_merchant, raw_description FROM canon) JOIN rules
             ON CASE kind WHEN 'canonical' THEN lower(coalesce(canonical_merchant, '')) = lower(pattern) WHEN 'exact' THEN upper(normalized_merchant) = upper(pattern)
                ELSE regexp_matches(coalesce(canonical_merchant, ''), pattern) OR regexp_matches(normalized_merchant, pattern) OR regexp_matches(raw_description, pattern) END GROUP BY 1, 2, 3),
classed AS (SELECT c.* EXCLUDE (dcat, dsub), CASE WHEN h.rule_idx IS NOT NULL THEN r.category ELSE dcat END AS category0,
                   CASE WHEN h.rule_idx IS NOT NULL THEN coalesce(r.subcategory, '') WHEN dcat IS NOT NULL THEN coalesce(dsub, '') END AS subcategory,
                   CASE WHEN h.rule_idx IS NOT NULL THEN 'rule' WHEN dcat IS NOT NULL THEN 'merchant' END AS by0
            FROM canon c LEFT JOIN rule_hit h ON c.normalized_merchant = h.normalized_merchant AND c.raw_description = h.raw_description AND c.canonical_merchant IS NOT DISTINCT FROM h.canonical_merchant LEFT JOIN rules r USING (rule_idx)),
ledger AS (SELECT * EXCLUDE (category0, by0), CASE WHEN category0 IS NULL AND txn_id[1] = 'f' THEN 'Other' ELSE category0 END AS category,
                  CASE WHEN category0 IS NULL AND txn_id[1] = 'f' THEN 'ai' ELSE by0 END AS classified_by,
                  CASE WHEN txn_id < '2' THEN ['gift'] WHEN txn_id < '4' THEN ['beach', 'work'] ELSE [] END AS tags,
                  'inbox/' || source_document_id || '.csv' AS source_file, strftime(posted_date, '%Y-%m') AS month FROM classed)
"""
