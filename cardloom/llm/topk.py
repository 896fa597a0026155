"""Exact top-k search by inner product: a KD-tree in each shard, best-first, with a propagated kth score.

A KD-tree fitted to a bounded sample deals the vectors out to shards (it only balances them). Each query first searches
the shard whose bounding box promises most; its kth score so far then goes along to the other shards whose boxes can
still hold something better, and the partial results are merged. In a shard, median splits give leaves with tight boxes;
a query meets the leaves in the order of their bounds, sum over the dimensions of max(q*low, q*high), and stops where no
leaf can beat its kth result. Queries come in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import stored, table

K = 20
SCALE = 64
#: Vectors that the shards are fitted to: so many at least, so many a shard, so many bytes of them at most.
SAMPLE, SAMPLE_A_SHARD, SAMPLE_BYTES = 8_192, 8, 64 << 20
#: Vectors a shard and a leaf should hold; queries in a block; most shards, as their boxes are broadcast. A shard that holds more
#: than twice what it should is searched in pieces, so no task grows with the input.
SHARD, LEAF, BLOCK, MOST_SHARDS = 8_192, 128, 8_192, 4_096
_NONE = np.iinfo(np.int64).min


def split(x: np.ndarray, depth: int) -> tuple | None:
    """KD-tree (dimension, value, lower, upper): the widest dimension is cut at its median; None is a leaf."""
    if depth <= 0 or len(x) < 2:
        return None
    d = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
    cut = np.median(x[:, d])
    low = x[:, d] <= cut
    if low.all():
        low = x[:, d] < cut
        cut = np.nextafter(cut, -np.inf)
    if not low.any():
        return None
    return d, cut, split(x[low], depth - 1), split(x[~low], depth - 1)


def leaf_of(tree: tuple | None, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    stack = [(tree, 1, np.arange(len(x)))]
    while stack:
        node, name, at = stack.pop()
        if node is None:
            out[at] = name
            continue
        d, cut, low, high = node
        lower = x[at, d] <= cut
        stack += [(low, 2 * name, at[lower]), (high, 2 * name + 1, at[~lower])]
    return out


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product each query (row) can have with anything in each box (column)."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def products(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floats while all sums are below 2^53, else in 64-bit integers."""
    if queries.size and x.size and np.abs(queries).max() * np.abs(x).max() * x.shape[1] < 2**53:
        return (queries @ x.T).astype(np.int64)
    return queries.astype(np.int64) @ x.astype(np.int64).T


class Shard:
    """A shard's vectors in leaves with tight boxes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        depth = int(np.ceil(np.log2(max(1, len(x) / LEAF))))
        leaf = leaf_of(split(x, depth), x)
        order = np.lexsort((ids, leaf))
        self.ids, self.x = ids[order], x[order]
        begin = np.flatnonzero(np.append(True, leaf[order][1:] != leaf[order][:-1]))
        self.cuts = np.append(begin, len(order))
        self.low, self.high = np.minimum.reduceat(self.x, begin), np.maximum.reduceat(self.x, begin)
        self.first_id = self.ids[begin]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the shard's share of each query's best k; kth and kth_id are what must be beaten."""
        n = len(queries)
        best, best_id = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)
        kth, kth_id = kth.copy(), kth_id.copy()
        bound = bounds(queries, self.low, self.high)
        order = np.argsort(-bound, axis=1, kind="stable")
        alive = np.arange(n)
        for r in range(order.shape[1]):
            leaf = order[alive, r]
            top = bound[alive, leaf]
            alive = alive[top >= kth[alive]]  # the leaves come in falling order, so the rest can't beat it either
            if not len(alive):
                break
            leaf = order[alive, r]
            useful = (bound[alive, leaf] > kth[alive]) | (self.first_id[leaf] < kth_id[alive])
            by_leaf = np.argsort(leaf, kind="stable")
            by_leaf = by_leaf[useful[by_leaf]]
            cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
            for group in np.split(by_leaf, cuts):
                if not len(group):
                    continue
                q = alive[group]
                s = slice(*self.cuts[leaf[group[0]] : leaf[group[0]] + 2])
                score = products(queries[q], self.x[s])
                score[query_ids[q][:, None] == self.ids[s][None, :]] = _NONE
                scores = np.concatenate((best[q], score), axis=1)
                ids = np.concatenate((best_id[q], np.broadcast_to(np.where(score == _NONE, np.iinfo(np.int64).max, self.ids[s]), score.shape)), axis=1)
                if scores.shape[1] > 4 * k:  # what is below the kth score goes before the full sort
                    edge = np.partition(scores, -k, axis=1)[:, -k][:, None]
                    width = int((scores >= edge).sum(axis=1).max())
                    part = np.argsort(~(scores >= edge), axis=1, kind="stable")[:, :width]
                    scores, ids = np.take_along_axis(scores, part, 1), np.take_along_axis(ids, part, 1)
                keep = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~ falls as scores rise, without overflow
                best[q], best_id[q] = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
                better = (best[q, -1] > kth[q]) | ((best[q, -1] == kth[q]) & (best_id[q, -1] < kth_id[q]))
                kth[q[better]], kth_id[q[better]] = best[q[better], -1], best_id[q[better], -1]
        i, j = np.nonzero(best > _NONE)
        return i, best_id[i, j], best[i, j]


def top_k(vectors: DataFrame, every: int, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` its k best other rows by the inner
    product of floor(scale * component), ties to the smaller id.

    Vectors that are null, or hold null or non-finite components, or have no id, take no part. Shorter vectors count as
    filled up with zeros. Rows that repeat an id are candidates each, but never for a query of their own id; a repeated
    query id gets the results of one of its rows (the first by vector). Other columns are left out; no rows give none.
    Products beyond 64 bits are not caught.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        "id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    )
    clean = stored(clean.select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")).alias("v")))
    total, wide, narrow = clean.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    wide = max(1, wide or 1)
    # Of equal vectors only the k + 1 smallest ids can be among anyone's best k; the rest of a large group never gathers.
    equal = W.partitionBy("v").orderBy("id")
    candidates = clean.withColumn("place", F.dense_rank().over(equal)).where(F.col("place") <= k + 1).drop("place")

    def matrix(column: pd.Series) -> np.ndarray:
        out, rows = np.zeros((len(column), wide)), column.tolist()
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        out[np.arange(wide) < lengths[:, None]] = np.concatenate([np.zeros(0), *rows])
        return out

    shards = min(MOST_SHARDS, max(1, total / SHARD))
    rows = min(max(SAMPLE, int(SAMPLE_A_SHARD * shards)), max(1, SAMPLE_BYTES // (8 * wide)))
    sample = matrix(clean.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(rows).select("v").toPandas()["v"])
    tree = spark.sparkContext.broadcast(split(sample, int(np.ceil(np.log2(shards)))))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(shard=leaf_of(tree.value, matrix(b["v"])))

    dealt = stored(candidates.mapInPandas(deal, "id long, v array<double>, shard long"))
    pieces = F.broadcast(stored(dealt.groupBy("shard").agg(F.ceil(F.count("*") / (2 * SHARD)).cast("int").alias("pieces"))))  # a row a shard
    # Tight boxes of the shards, a row for each of at most MOST_SHARDS * 2.
    flat = dealt.select("shard", F.posexplode("v").alias("d", "x")).groupBy("shard", "d").agg(F.min("x").alias("low"), F.max("x").alias("high")).toPandas()
    names = np.sort(flat["shard"].unique())
    low, high = np.zeros((len(names), wide)), np.zeros((len(names), wide))
    at = (np.searchsorted(names, flat["shard"].to_numpy()), flat["d"].to_numpy())
    low[at], high[at] = flat["low"].to_numpy(), flat["high"].to_numpy()
    if narrow != wide:  # some vectors are filled up with zeros
        low, high = np.minimum(low, 0), np.maximum(high, 0)
    boxes = spark.sparkContext.broadcast((names, low, high))

    queries = clean.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("q"))

    def choose(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            name, lo, hi = boxes.value
            for b in batches:
                if not len(b):
                    continue
                q = matrix(b["q"])
                bound = bounds(q, lo, hi)
                home = bound.argmax(axis=1)
                if first:
                    yield b.assign(kth=_NONE, kth_id=np.iinfo(np.int64).max, shard=name[home])
                    continue
                reach = bound >= b["kth"].to_numpy()[:, None]
                reach[np.arange(len(b)), home] = False
                i, j = np.nonzero(reach)
                yield b.iloc[i].assign(shard=name[j])

        return run

    def search(key: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(x["id"].to_numpy(np.int64), matrix(x["v"]))
        ids = q["id"].to_numpy(np.int64)
        i, found, score = shard.search(ids, matrix(q["q"]), k, q["kth"].to_numpy(np.int64), q["kth_id"].to_numpy(np.int64))
        return pd.DataFrame({"query_id": ids[i], "vec_id": found, "score": score})

    def in_shards(asked: DataFrame) -> DataFrame:
        # A shard's vectors are sent once for each block of queries that reach it, and not at all where none does.
        blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        blocks = F.broadcast(stored(blocks.join(pieces, "shard")))  # a row a shard
        own = lambda by, n: F.pmod(F.xxhash64(F.lit(by), "id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = dealt.join(blocks, "shard").withColumn("piece", own(9, "pieces")).withColumn("block", each("blocks")).drop("blocks", "pieces")
        q = asked.join(blocks, "shard").withColumn("block", own(3, "blocks")).withColumn("piece", each("pieces")).drop("blocks", "pieces")
        both = x.groupBy("shard", "piece", "block").cogroup(q.groupBy("shard", "piece", "block"))
        return both.applyInPandas(lambda key, x, q: search(key, x, q) if len(x) and len(q) else search_none(), "query_id long, vec_id long, score long")

    def search_none() -> pd.DataFrame:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    asked_ddl = "id long, q array<double>, kth long, kth_id long, shard long"
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    first = stored(in_shards(queries.mapInPandas(choose(True), asked_ddl)).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
    worst = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("vec_id")).alias("back"))).alias("w"))
    full = F.col("n") >= k
    told = queries.join(worst, queries["id"] == worst["query_id"], "left").select(
        "id", "q", F.when(full, F.col("w.score")).otherwise(F.lit(_NONE)).alias("kth"), F.when(full, -F.col("w.back")).otherwise(F.lit(2**63 - 1)).alias("kth_id")
    )
    rest = in_shards(told.mapInPandas(choose(False), asked_ddl))
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best matches of each embedding whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), every=20)


QUERIES = {"op6_kdtree_topk": op6_kdtree_topk}
ORACLES = {
    "op6_kdtree_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
