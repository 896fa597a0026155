"""Fuzzy clusters of unknown merchants: greedy leaders by token-set ratio, exact and distributed.

Two names can only join if the first words of their identity keys are equal, and leaders are taken by falling spend; so
the greedy run inside each block of one first word, in that order, equals the global run. Names of one key move
together, so a block holds distinct keys only. A block of many keys is run in rounds: the next keys in order find their
leaders among themselves, and all that are left, in tiles, look for theirs among these; who finds none waits for the next
round. No task holds more than CHUNK keys and as many leaders."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..tables import kept
from .identity import merchant_identity_key

THRESHOLD = 88
#: Keys that a task compares with each other or with leaders.
CHUNK = 2_048


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & places.get(c, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


@lru_cache(65_536)
def token_set_ratio(a: str, b: str) -> float:
    """How alike two texts are as sets of words, 0 to 100: the best of comparing what they share, and what they share
    with the rest of each."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    more, less = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not more or not less):
        return 100.0
    s, x, y = len(shared), len(more), len(less)
    gap = int(s > 0)
    one, two = s + gap + x, s + gap + y
    apart = x + y - 2 * _common(more, less)
    best = 100 * (1 - apart / (one + two)) if one + two else 100.0
    if s:
        best = max(best, 100 * (1 - (gap + x) / (s + one)), 100 * (1 - (gap + y) / (s + two)))
    return best


def token_set_ratio_udf():
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b)])

    return ratio


def _leader(key: str, leaders: list[str], threshold: float) -> str | None:
    return next((one for one in leaders if token_set_ratio(one, key) >= threshold), None)


def _led(keys: DataFrame, threshold: float, chunk: int | None = None) -> DataFrame:
    """(key, leader) of keys (key, back, name, block): in the order of back and name each joins the first leader of its block that is
    alike enough, or leads."""
    chunk = chunk or CHUNK

    def greedy(block: pd.DataFrame) -> pd.DataFrame:
        leaders: list[str] = []
        out = []
        for key in block.sort_values(["back", "name"])["key"]:
            leader = _leader(key, leaders, threshold)
            if leader is None:
                leaders.append(key)
            out.append((key, leader or key))
        return pd.DataFrame(out, columns=["key", "leader"])

    def meet(tile: pd.DataFrame) -> pd.DataFrame:
        known = tile[tile["leads"]].sort_values("place")["key"].tolist()
        waiting = tile[~tile["leads"]].drop(columns=["tile", "leads"])
        return waiting.assign(leader=pd.Series([_leader(key, known, threshold) for key in waiting["key"]], waiting.index, dtype=object))

    hot = keys.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("block")  # fewer than the keys by `chunk`
    hot = kept(hot)
    if hot.isEmpty():
        return keys.groupBy("block").applyInPandas(greedy, "key string, leader string")
    found = keys.join(hot, "block", "left_anti").groupBy("block").applyInPandas(greedy, "key string, leader string")
    order = ("block", "back", "name")
    pending = keys.join(hot, "block", "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    pending = kept(pending.select(*order, "key").withColumn("place", F.monotonically_increasing_id()))
    while True:
        rank = F.row_number().over(W.partitionBy("block").orderBy("place"))
        head = kept(pending.withColumn("rank", rank).where(F.col("rank") <= chunk).drop("rank"))
        if head.isEmpty():
            return found
        now = kept(head.groupBy("block").applyInPandas(greedy, "key string, leader string"))
        found = found.unionByName(now)
        rest = pending.join(head.groupBy("block").agg(F.max("place").alias("last")), "block").where("place > last").drop("last")
        tiles = -(-rest.count() // chunk)
        if not tiles:
            return found
        columns = ["block", "back", "name", "key", "place"]
        leaders = head.join(now.where("key = leader").select("key"), "key", "left_semi").select(*columns, F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(True).alias("leads"))
        tiled = rest.select(*columns, F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int").alias("tile"), F.lit(False).alias("leads"))
        ends = tiled.unionByName(leaders).groupBy("block", "tile").applyInPandas(meet, "block string, back double, name string, key string, place bigint, leader string")
        ends = kept(ends)
        found = found.unionByName(ends.where("leader is not null").select("key", "leader"))
        pending = ends.where("leader is null").drop("leader")


def cluster_unknowns(ledger: DataFrame, threshold: float = THRESHOLD, min_size: int = 1) -> DataFrame:
    """(cluster_id, representative, members, sample_raw, txn_count, total_amount) over names without a canonical one, the
    largest total first. Ties go to the first name; clusters of fewer than min_size transactions are left out."""
    unknown = ledger.where("coalesce(canonical_merchant, '') = ''").where("normalized_merchant is not null")
    stats = unknown.groupBy("normalized_merchant").agg(F.count("*").alias("txn_count"), F.sum("amount").alias("total"), F.min("raw_description").alias("sample_raw"))
    named = stats.withColumn("key", merchant_identity_key("normalized_merchant"))
    best = F.min(F.struct((-F.col("total")).alias("back"), F.col("normalized_merchant").alias("name"))).alias("best")
    keys = named.groupBy("key").agg(best).select("key", "best.back", "best.name", F.split("key", " ")[0].alias("block"))

    led = _led(keys.withColumn("back", F.col("back").cast("double")), threshold)
    clusters = named.join(led, "key").groupBy("leader").agg(
        F.min(F.struct((-F.col("total")).alias("back"), F.col("normalized_merchant").alias("name"), "sample_raw")).alias("first"),
        F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("back"), F.col("normalized_merchant").alias("name")))).alias("all"),
        F.sum("txn_count").alias("txn_count"), F.sum("total").cast("decimal(28,2)").alias("total_amount"),
    )
    return clusters.where(F.col("txn_count") >= min_size).select(
        slugify("first.name").alias("cluster_id"), F.col("first.name").alias("representative"), F.transform("all", lambda m: m["name"]).alias("members"),
        F.col("first.sample_raw").alias("sample_raw"), "txn_count", "total_amount",
    ).orderBy(F.desc("total_amount"), "representative")
