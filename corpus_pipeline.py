"""Corpus pipeline over `documents`: language ID, near-duplicates, decontamination, personal data, source mix.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; its result is written as Parquet and read again
for the next. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import decontaminate, language_id, mixing, pii, simhash
from cardloom.llm._spark import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter of any language; `lang` becomes the predicted language. Other columns stay, whatever their names."""
    model = language_id.fit(docs.where(~language_id.held_out()), "doc_id", "text", "lang")
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of these can be one of the prediction's
    found = language_id.predict(docs.toDF(*plain.values()), model, plain["doc_id"], plain["text"], keep=tuple(plain.values()))
    return found.where("lang_pred <> 'und'").select(*[F.col("lang_pred" if c == "lang" else name).alias(c) for c, name in plain.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity of 0.8 or more): the one with the
    smallest id. Rows without an id, or with one that other texts have too, are judged by their texts like all others."""
    return simhash.drop_near_copies(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, each judged by its own text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by marks; n_chars follows."""
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many words it takes of each (repeats counted) and the shards they go to; columns of
    these two names that the documents have are left out."""
    found = mixing.mix_sources(docs, keep=True).where("taken > 0")
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("taken", "shards")], "taken", F.concat_ws(",", "shards").alias("shards"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("source_mix", mix),
]

#: Fingerprints, mixtures of languages and the random field are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
