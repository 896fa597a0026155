"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over block quotas.

Documents fall into blocks of their source by a hash. A source whose target is r times its size gives all its blocks
floor(r) times, and for the rest blocks in a pseudo-random order until the target is met; the block on the edge is cut
the same way into sub-blocks, and the sub-block on the edge into documents. The draws of all sources are then split
among the output shards by a binary tree: each node deals half of its draws, a uniform subset of exact size, to either
child, so the counts by source in a child are multivariate hypergeometric, and the shards' quotas add up to the sources'
exactly. A shard's quota of a source takes the next blocks of the source's permuted list, disjoint from those of other
shards, and a shard orders its documents by a hash of its own. All choices follow from hashes and the seed: reruns
agree. DataFrame functions only; the tables of sources and draws have at most 257 draws a source and pass, and
no window spans all sources or all draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import small, stored, table

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCKS = 256
LEVELS = 4
SEED = "mix-1"
#: Documents that fill a source up to its target, one after another.
FILLS = 4
WORD = r"[^\x20\x09-\x0D]+"


def _digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts))


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def before(rows: DataFrame, order: list[str], sums: dict[str, Column], all_: str = "all_", prior: str = "") -> DataFrame:
    """`rows` with the sums over the rows that come before in `order`, and those over all rows, each as a prefix and its name.

    Ranges of the order are summed on their own, and the sums of the ranges before are added, so a task holds a range at most.
    """
    parts = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    own = W.partitionBy("range").orderBy(*order)
    inside = parts.withColumns({f"_in_{n}": F.sum(x).over(own) - x for n, x in sums.items()})
    ranges = parts.groupBy("range").agg(*[F.sum(x).alias(f"_of_{n}") for n, x in sums.items()])  # a row a partition
    lower = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("range", *[
        c for n in sums for c in (F.coalesce(F.sum(f"_of_{n}").over(lower), F.lit(0)).alias(f"_to_{n}"), F.sum(f"_of_{n}").over(W.partitionBy()).alias(f"{all_}{n}"))
    ])
    out = inside.join(F.broadcast(ranges), "range").withColumns({f"{prior}{n}": F.col(f"_to_{n}") + F.col(f"_in_{n}") for n in sums})
    return out.drop("range", *[f"_{k}_{n}" for k in ("in", "to") for n in sums])


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, source_size, target) of each source of `sizes` (key, source_size): the weights repeat in key order and share
    `share` times all sizes; a target stops at `most` times its source's size and the excess is shared anew.

    The sources that stop are the first ones by size over weight, so one pass in that order finds the level at which the
    others meet: the largest of (what is left) / (weights left).
    """
    numbered = before(sizes, ["key"], {"n": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    capped = numbered.select("key", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    capped = capped.withColumn("stops", F.col("cap") / F.col("w"))
    table_ = before(capped, ["stops", "key"], {"cap": F.col("cap"), "w": F.col("w"), "source_size": F.col("source_size")}, "all_", "prior_")
    left = (share * F.col("all_source_size") - F.col("prior_cap")) / (F.col("all_w") - F.col("prior_w"))
    level = table_.agg(F.max(left)).first()[0]
    return table_.select("key", "source_size", F.least("cap", F.lit(level).cast("double") * F.col("w")).alias("target"))


def _edge(units: DataFrame, keys: list[str], unit: str, tag: str) -> DataFrame:
    """Units in permuted order with `want`, the words still to take: whole ones fit, the one on the edge is cut further."""
    order = W.partitionBy(*keys).orderBy(_digest(F.lit(tag), *keys, F.col(unit).cast("string")), unit).rowsBetween(W.unboundedPreceding, 0)
    through = F.sum("words").over(order)
    return units.withColumn("through", through).withColumn("fits", F.col("through") <= F.col("want")).withColumn(
        "edge", ~F.col("fits") & (F.col("through") - F.col("words") < F.col("want")) & (F.col("words") > 0)
    ).withColumn("want_inside", F.col("want") - (F.col("through") - F.col("words")))


def split_draws(draws: DataFrame, levels: int) -> DataFrame:
    """`draws` (key, pass, block) with the shard that each goes to: the tree deals out quotas, the quotas take blocks.

    A node's first half are its draws of the smallest hashes, half of them to one. Counts by leading digits of the hash tell which
    digits the last of these has; only draws with these are ordered, so no task holds all draws of a node.
    """
    units = stored(draws.withColumn("unit", F.row_number().over(W.partitionBy("key").orderBy("pass", "block"))).withColumn("node", F.lit(1)))
    for level in range(levels):
        drawn = units.withColumn("draw", F.struct(_digest(F.lit(f"tree{level}"), "key", F.col("unit").cast("string")).alias("mark"), "key", "unit"))
        drawn = drawn.withColumn("bucket", F.substring("draw.mark", 1, 3))
        # The bucket that holds the last draw of a node's first half, by counts, and that draw by its place in the bucket alone.
        counts = drawn.groupBy("node", "bucket").agg(F.count("*").alias("n"))
        inside = W.partitionBy("node")
        half = F.floor((F.sum("n").over(inside) + F.col("node") % 2) / 2)
        counts = counts.withColumns({"left": half - F.sum("n").over(inside.orderBy("bucket")) + F.col("n")})
        edge = F.broadcast(counts.where("left between 1 and n").select("node", "bucket", "left"))  # a row a node
        place = F.row_number().over(W.partitionBy("node").orderBy("draw"))
        last = drawn.join(edge, ["node", "bucket"]).select("node", "left", "draw", place.alias("place")).where("place = left")
        last = stored(last.select("node", F.col("draw").alias("last")))
        right = ~F.coalesce(F.col("draw") <= F.col("last"), F.lit(False))
        units = drawn.join(F.broadcast(last), "node", "left").select("key", "unit", (F.col("node") * 2 + right.cast("int")).alias("node"))
    shards = units.select("key", (F.col("node") - 2**levels).alias("shard"), F.row_number().over(W.partitionBy("key").orderBy("node", "unit")).alias("place"))
    listed = draws.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("pass", _digest(F.lit("list"), "key", F.col("pass").cast("string"), F.col("block").cast("string")), "block")))
    return listed.join(shards, ["key", "place"]).drop("place")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int = LEVELS, keep: bool = False, **shares) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards, orders) for each row; size is in words, taken the words that
    the mix takes, repeats counted: 0, 1 or 2 times the size; shards lists where each copy goes, orders by what its shard is
    shuffled (see write_order). With `keep`, row holds all
    columns of the row.

    Null sources are one source, the last; a null text has size 0. Rows without words take nothing and go nowhere.
    Repeated rows fall into the same block but are counted each. Other columns are left out; no rows give no rows. A
    source's taken words miss its target by less than half the size of one document (or of rows that repeat its doc_id).
    """
    mark = _digest(F.lit("doc"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    part = lambda a: F.conv(F.substring("mark", a, 2), 16, 10).cast("int")
    every = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), source_col), F.lit("z")).alias("key"),  # null last
        size_in_words(F.col(text_col)).alias("size"),
        mark.alias("mark"),
        *([F.struct("*").alias("row")] if keep else []),
    ).withColumns({"block": part(1), "sub": part(3)})
    sized = stored(every.drop("row"))

    subs = stored(sized.groupBy("key", "block", "sub").agg(F.sum("size").alias("words")))
    blocks = subs.groupBy("key", "block").agg(F.sum("words").alias("words"))
    targets = source_targets(subs.groupBy("key").agg(F.sum("words").alias("source_size")), **shares)
    targets = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    targets = targets.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    targets = small(stored(targets))

    want = F.col("rest").alias("want")
    by_block = stored(_edge(blocks.join(targets, "key").select("key", "block", "words", "passes", want), ["key"], "block", "block"))
    edge_block = by_block.where("edge").select("key", "block", F.col("want_inside").alias("want"))
    by_sub = _edge(subs.join(small(edge_block), ["key", "block"]), ["key", "block"], "sub", "sub")
    by_sub = stored(by_sub.select("key", "block", "sub", "words", "fits", "edge", "want_inside"))
    edge_sub = by_sub.where("edge").select("key", "block", "sub", F.col("want_inside").alias("want"))
    near = sized.join(small(edge_sub), ["key", "block", "sub"]).where("size > 0")
    rows = near.groupBy("key", "block", "sub", "want", "mark").agg(F.sum("size").alias("words"))
    by_doc = _edge(rows, ["key", "block", "sub"], "mark", "mark")
    fitting = by_doc.where("fits").select("key", "mark")
    # What is missing then is filled by documents left over: the largest that still fits, some times, and in the end the one
    # whose size is nearest to what is missing, if that is nearer than none.
    gaps = stored(by_doc.where("edge").select("key", F.col("want_inside").alias("missing"), F.array().cast("array<struct<mark:string,block:int>>").alias("picked")))
    left = sized.where("size > 0").join(small(by_block.where("not fits").select("key", "block")), ["key", "block"])
    left = left.join(small(by_sub.where("fits").select("key", "block", "sub")), ["key", "block", "sub"], "left_anti")
    left = left.join(small(stored(fitting)), ["key", "mark"], "left_anti").join(small(gaps.select("key", "missing")), "key")
    left = stored(left.where("size < 2 * missing").select("key", "mark", "block", "size"))  # what is missing only shrinks
    for n in range(FILLS):
        near = left.join(small(gaps), "key").where(~F.exists("picked", lambda p: p["mark"] == F.col("mark"))).withColumn("off", F.abs(F.col("size") - F.col("missing")))
        best = F.min(F.struct("off", "mark", "block", "size")).alias("f")
        pick = near.where("off < missing" if n == FILLS - 1 else "size <= missing").groupBy("key").agg(best)
        more = F.when(F.col("f").isNotNull(), F.array(F.struct("f.mark", "f.block"))).otherwise(F.array())
        gaps = gaps.join(pick, "key", "left").select("key", (F.col("missing") - F.coalesce("f.size", F.lit(0))).alias("missing"), F.concat("picked", more).alias("picked"))
        gaps = stored(gaps)
    filling = gaps.select("key", F.explode("picked").alias("p")).select("key", "p.*")
    some_docs = fitting.unionByName(filling.select("key", "mark")).distinct().withColumn("by_doc", F.lit(True))
    some_subs = by_sub.where("fits").select("key", "block", "sub", F.lit(True).alias("by_sub"))

    full = by_block.where("passes > 0 and words > 0").select("key", "block", F.explode(F.sequence(F.lit(1), "passes")).alias("pass"))
    cut_blocks = by_block.where("edge").select("key", "block").unionByName(filling.select("key", "block")).distinct()
    whole_blocks = by_block.where("fits and words > 0 and want > 0").select("key", "block")
    rest = whole_blocks.unionByName(cut_blocks).join(targets.select("key", (F.col("passes") + 1).alias("pass")), "key")
    drawn = split_draws(stored(full.unionByName(rest)), levels)
    edge_of = cut_blocks.join(targets.select("key", (F.col("passes") + 1).alias("cut_pass")), "key")
    drawn = drawn.join(edge_of, ["key", "block"], "left")
    cut = F.coalesce(F.col("pass") == F.col("cut_pass"), F.lit(False))
    places = drawn.groupBy("key", "block").agg(
        F.array_sort(F.collect_list(F.when(~cut, F.col("shard")))).alias("whole"), F.max(F.when(cut, F.col("shard"))).alias("cut_shard")
    )
    # With whole rows the texts are read again here: all tables joined to them are small, so no text is shuffled.
    out = (every if keep else sized).join(small(targets.select("key", "source_size", "target")), "key").join(small(stored(places)), ["key", "block"], "left")
    out = out.join(small(some_subs), ["key", "block", "sub"], "left").join(small(stored(some_docs)), ["key", "mark"], "left")
    extra = F.col("cut_shard").isNotNull() & F.coalesce("by_sub", "by_doc", F.lit(False))
    shards = F.concat(F.coalesce("whole", F.array().cast("array<int>")), F.when(extra, F.array("cut_shard")).otherwise(F.array().cast("array<int>")))
    shards = F.when(F.col("size") > 0, shards).otherwise(F.array().cast("array<int>"))
    out = out.select(*(["row"] if keep else []), "doc_id", "source", "size", "source_size", "target", "mark", shards.alias("shards"))
    order = F.transform("shards", lambda s, i: F.xxhash64(F.lit(SEED), s, i, F.col("mark")))
    return out.withColumn("taken", F.col("size") * F.size("shards")).withColumn("orders", order).drop("mark")


def write_order(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus itself: a row for each copy of a document, the copies of a shard together and shuffled among
    themselves by their `orders`. A shard may be several partitions: ranges of its own shuffled order."""
    copies = mixed.select(F.col("doc_id").alias(id_col), F.explode(F.arrays_zip("shards", "orders")).alias("c")).distinct()
    rows = docs.join(copies, id_col).select(*docs.columns, F.col("c.shards").alias("shard"), F.col("c.orders").alias("order"))
    return rows.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").drop("order")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, by weights 5, 2, 1 over the sources."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.concat_ws(",", "shards").alias("shards"), F.concat_ws(",", F.transform("orders", lambda x: x.cast("string"))).alias("orders"))


QUERIES = {"op9_source_mix": op9_source_mix}
ORACLES: dict[str, str] = {}
