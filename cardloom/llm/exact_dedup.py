"""Exact dedup: an extendible-hash index of all texts on shared files.

Each text has a 64-bit hash. A directory maps the hashes' leading bits to buckets: it starts with as many entries as the
number of different hashes asks for, and while a bucket holds more than CAPACITY of them it doubles and the overfull
buckets split. The index (hash, rows, bucket) is a table in the shared folder. Buckets follow the order of the hashes, so
each owner task has a range of keys. Owners get the texts of those hashes that several rows have, one text for each task
that read it, chain different texts of one hash, and compare bytes; what they decide goes back to the rows under the
texts' names, which are SHA-256 digests. No decision rests on a digest: should two texts of one digest differ, the job
fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import in_arrow, small, stored, table, unused
from .url_rules import LOWER, UPPER

#: Different hashes that a bucket may hold before it splits.
CAPACITY = 65_536
#: Doublings of the directory beyond what the number of hashes asks for. Hashes of texts spread evenly and need one or two;
#: a bucket that is overfull even then stays one.
DOUBLINGS = 8
#: Bytes of different texts that a task remembers before it forgets them; a text met again is then sent again.
MEMORY = 32 << 20
#: A hot hash's texts meet in so many places first, and these meet in its owner.
SALTS = 32
NORMAL = {"none": lambda c: c, "trim": F.trim, "lower": lambda c: F.translate(c, UPPER, LOWER), "space": lambda c: F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))}


def prefix(h: Column | str, depth: int) -> Column:
    """The leading bits of a signed 64-bit hash, in the order of unsigned numbers."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int = CAPACITY, bits: int = 64) -> tuple[DataFrame, int]:
    """((entry, bucket), depth) of a table of different hashes `h`, of which `bits` leading bits vary: of 2^depth entries those
    that hold some hash, each with the first entry of its bucket. A bucket of more than `capacity` hashes is split, DOUBLINGS times at most. No
    hashes give no entry. Only the number of hashes and of overfull buckets come to the driver, once a doubling."""
    depth = min(bits, max(0, (hashes.count() // capacity).bit_length()))
    count = lambda rows, d: rows.groupBy(prefix("h", d).alias("at")).agg(F.count("*").alias("n"))
    now = stored(count(hashes, depth).withColumn("depth", F.lit(depth)))
    done = now.limit(0)
    for _ in range(min(DOUBLINGS, bits - depth)):
        full = now.where(F.col("n") > capacity)
        if full.isEmpty():
            break
        done = done.unionByName(now.where(F.col("n") <= capacity))
        of_full = hashes.withColumn("_at", prefix("h", depth)).join(small(full.select(F.col("at").alias("_at"))), "_at", "left_semi")
        depth += 1
        now = stored(count(of_full, depth).withColumn("depth", F.lit(depth)))
    buckets = done.unionByName(now)
    shift = F.lit(depth) - F.col("depth")
    first = F.expr(f"shiftleft(at, {depth} - depth)")
    held = buckets.select(first.alias("bucket"), F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - depth)") - 1)).alias("entry"))
    return stored(held.select("entry", "bucket")), depth


def _compared(batches: Iterator[pa.RecordBatch], memory: float = MEMORY) -> Iterator[pa.RecordBatch]:
    """Of rows (owner, h, name, text) those whose text differs in its bytes from all texts that came under its hash before.

    Each hash has a chain of the texts met; rows that are sorted by hash need one chain at a time. Beyond `memory` the
    chains are forgotten, which sends some texts twice and loses none."""
    chains: dict[int, list[tuple[bytes, bytes]]] = {}
    held = 0
    for batch in batches:
        kept = []
        hashes, names, texts = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
        for i, h in enumerate(hashes):
            text, name = texts[i].as_py(), names[i].as_py()
            chain = chains.setdefault(h, [])
            known = next((n for n, t in chain if t == text), None)
            if known is not None:
                continue
            if any(n == name for n, _ in chain):
                raise RuntimeError(f"two texts have the SHA-256 digest {name}")
            if held > memory:
                chains, held = {h: chain}, sum(len(t) for _, t in chain)
            chain.append((name, text))
            held += len(text)
            kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, name, place): the chain of each hash, from rows sorted by hash; equal bytes have one place."""
    now, chain = None, []
    for batch in batches:
        rows = []
        for h, name, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if h != now:
                now, chain = h, []
            place = next((i for i, (_, t) in enumerate(chain) if t == text), None)
            if place is None:
                if any(n == name for n, _ in chain):
                    raise RuntimeError(f"two texts have the SHA-256 digest {name}")
                place = len(chain)
                chain.append((name, text))
                rows.append((h, name, place))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.string(), pa.int32()))], ["h", "name", "place"])


def text_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: str = "none", bits: int = 64, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(rows, index), both stored: rows (doc_id, h, name, uid) of all documents, and index (h, n, bucket, owner) of all
    different hashes; owner is the range of buckets that one task has."""
    text = NORMAL[normal](F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    h = F.xxhash64(text) if bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - bits), 64 - bits) if bits else F.lit(0).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), h.alias("h"), F.sha2(text, 256).alias("name"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()))
    hashes = stored(rows.groupBy("h").agg(F.count("*").alias("n")))
    entries, depth = directory(hashes.select("h"), capacity, bits)
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owner = F.floor(F.col("bucket") * float(owners) / float(2**depth)).cast("int")
    index = hashes.withColumn("entry", prefix("h", depth)).join(small(entries), "entry").select("h", "n", "bucket", owner.alias("owner"))
    return rows, stored(index)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: str = "none", bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row: groups of rows whose texts are byte for byte equal once
    normalised (none, trim, lower, space), the largest doc_id of the group, and whether this row stays.

    A null text counts as empty and a null doc_id is smaller than all others; of rows that repeat the largest doc_id one
    stays. Very long texts are texts like others. Other columns are left out, whatever their names. No rows give no rows.
    A group that holds a third of all rows sends one text for each task that read it. `bits` and `capacity` are there for
    small indexes: with few bits many texts share a hash, and the result is the same."""
    rows, index = text_index(docs, id_col, text_col, normal, bits, capacity)
    several = small(stored(index.where("n > 1").select("h", "owner")))
    text = NORMAL[normal](F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    h = F.xxhash64(text) if bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - bits), 64 - bits) if bits else F.lit(0).cast("long")
    ddl = "owner int, h long, name string, text string"
    texts = docs.select(text.alias("text")).withColumns({"h": h}).join(several, "h").select("owner", "h", F.sha2("text", 256).alias("name"), "text")
    once = in_arrow(texts, _compared, ddl)
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = once.repartition(owners, "h", F.pmod(F.spark_partition_id(), F.lit(SALTS))).sortWithinPartitions("h")
    owned = in_arrow(salted, _compared, ddl).repartition(owners, "owner").sortWithinPartitions("owner", "h")
    chains = stored(in_arrow(owned, _numbered, "h long, name string, place int"))

    best = F.max(F.struct("doc_id", "uid")).alias("best")
    named = rows.groupBy("h", "name").agg(F.count("*").alias("n"), best)
    # A hash that one row has is a group of its own; the others' groups are the chains' places.
    grouped = named.join(chains, ["h", "name"])
    classes = grouped.groupBy("h", "place").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    found = stored(grouped.select("h", "name", "place").join(classes, ["h", "place"]).select("h", "name", "group_size", "best"))
    out = rows.join(small(found), ["h", "name"], "left")
    return out.select(
        "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.uid") == F.col("uid"), F.lit(True)).alias("kept"), F.col("name").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: str = "none") -> DataFrame:
    """`docs` without the rows that exact_duplicates doesn't keep. Rows are told apart by id and text; rows equal in both are one then."""
    mark, gone_id, gone_text = unused(docs, "_digest", "_gone_id", "_gone_text")
    gone = exact_duplicates(docs, id_col, text_col, normal).where("not kept and not (doc_id <=> keep_id)").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_text)).distinct()
    marked = docs.withColumn(mark, F.sha2(NORMAL[normal](F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), 256))
    kept = marked.join(small(gone), F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_text)), "left_anti")
    twice = kept.groupBy(id_col, mark).count().where("count > 1")
    return (kept if twice.isEmpty() else kept.dropDuplicates([id_col, mark])).drop(mark)


def op12_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op12_extendible_hash": op12_extendible_hash}
ORACLES = {
    "op12_extendible_hash": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
}
