"""SimHash near-duplicates: exact pairs within a Hamming radius through vantage-point trees.

Fingerprints are cut into two halves: if two of them differ in at most 3 bits, one half differs in at most 1. For each
half a vantage-point tree, fitted to a bounded sample of the distinct fingerprints, deals them out to shards by their
distances to the vantage points. A fingerprint lives in one shard and also visits each shard that the ball of radius 1
around its half reaches (the triangle bound), so every pair meets in some shard. Inside a shard a second tree prunes by
the same bound, and what is left is compared on all 64 bits. The sample only balances the shards; it never decides a
link. Of dense groups a shard returns a spanning set of links, not all pairs; connected components are the same.

For near copies at a lower similarity, fingerprints are longer: more lanes of 64 bits, each from hashes of its own, over
the distinct shingles. Bits disagree as often as the angle between the texts' shingle vectors is of a half turn, so a
similarity becomes a number of bits. Each lane gives three blocks of 21 bits with trees of their own, and two texts meet
where any block differs in at most 1 bit. Those that meet are linked by a minimum spanning forest of their distances, cut
well above the mean distance of the similarity asked for, and a link counts once the texts' shingles themselves are as
alike as asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._anchors import mix, ranges
from ._graph import connected_components
from ._spark import in_arrow, small, stored, table, tidy, unused
from ._text import doc_chunks, string_bytes, words

SEED = 42
MAX_BITS = 3
SHINGLE = 3
#: Distinct fingerprints a shard should hold, and a leaf of the tree inside it.
SHARD, LEAF = 8_192, 256
#: The same for fingerprints of several lanes, whose rows are wide: fewer shards send fewer of them to several.
WIDE_SHARD = 1 << 19
#: Bits of a block that has trees of its own: half a lane, or a third of one where there are several lanes.
HALF, THIRD = 32, 21
#: Distinct fingerprints that the shard trees are fitted to: so many at least, so many a shard, so many at most.
SAMPLE, SAMPLE_A_SHARD, MOST_SAMPLE = 16_384, 8, 1_048_576
#: Near copies by similarity: words a shingle, lanes of a fingerprint, least similarity.
NEAR_SHINGLE, LANES, SIMILARITY = 5, 7, 0.8
#: Standard deviations of the distance above its mean up to which texts are compared, and below it from which they count as
#: near copies without a comparison.
WIDER, SURE = 2.5, 4.0
#: Links that a shard holds before it reduces them to a forest.
MOST_LINKS = 1 << 22


def _shingles(column: pa.Array, shingle: int, seed: int, distinct: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, hashes, where each document's hashes begin) for stretches of a string column: A-Z lower-cased, words
    joined by one space; fewer words than a shingle are one shingle. The hashes are XXH64 of the shingles' bytes, repeats
    included; or, if distinct, sorted ones of the shingle's words, found for all bytes of a stretch at once."""
    data, offsets = string_bytes(pc.ascii_lower(column))
    for a, b in doc_chunks(offsets):
        part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = words(part, cuts)
        if not len(starts):
            continue
        # One space between words: each word's bytes and the byte after it, which becomes a space.
        lengths = ends - starts
        to = np.concatenate(([0], np.cumsum(lengths + 1)))
        keep = np.repeat(starts - to[:-1], lengths + 1) + np.arange(to[-1])
        joined = part[np.minimum(keep, len(part) - 1)].copy()
        joined[to[1:] - 1] = 32
        count = np.diff(first)
        grams = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        doc = np.repeat(np.arange(b - a), grams)
        at = np.concatenate(([0], np.cumsum(grams)))
        left = first[doc] + np.arange(at[-1]) - at[doc]
        right = np.minimum(left + shingle, first[doc + 1])
        if not distinct:
            yield a, b, _byte_hashes(joined, to[left], to[right] - 1, seed), at
            continue
        hashes = _word_hashes(joined, to, left, right, shingle, seed)
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))
        yield a, b, hashes[new], np.searchsorted(doc[new], np.arange(b - a + 1))


def simhash_batch(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED, lanes: int = 1) -> np.ndarray:
    """The fingerprints (uint64, a column for each lane) of a string column: a bit is 1 if over half of the shingles' hashes
    have it. One lane: of all shingles. Several: of the distinct ones, each lane mixing their hashes anew. No words: 0."""
    out = np.zeros((len(column), lanes), np.uint64)
    for a, _, hashes, at in _shingles(column, shingle, seed, lanes > 1):
        grams = np.diff(at)
        some = np.flatnonzero(grams)
        for s in range(0, len(some), 512):
            group = some[s : s + 512]
            for g0, g1 in _slices(at, group):
                h = hashes[at[group[g0]] : at[group[g1 - 1] + 1]]
                begin, count = at[group[g0:g1]] - at[group[g0]], grams[group[g0:g1]]
                for k in range(lanes):
                    own = mix(h ^ mix(np.full(1, k, np.uint64))) if k else h
                    majority = ones(own, begin, count) * 2 > count[:, None]
                    out[a + group[g0:g1], k] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_sets(column: pa.Array, shingle: int, seed: int = SEED) -> list[bytes]:
    """The sorted distinct hashes of each text's shingles."""
    out = [b""] * len(column)
    for a, b, hashes, at in _shingles(column, shingle, seed, True):
        for i in range(b - a):
            out[a + i] = hashes[at[i] : at[i + 1]].tobytes()
    return out


def _byte_hashes(joined: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of stretches of bytes."""
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.fromiter((digest(view[i:j], seed) for i, j in zip(low.tolist(), high.tolist())), np.uint64, len(low))


def _word_hashes(joined: np.ndarray, to: np.ndarray, left: np.ndarray, right: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """A hash of each run of words left..right: a word's is the sum of its bytes' mixed with their places, a run's chains its words'."""
    place = np.arange(to[-1]) - np.repeat(to[:-1], np.diff(to))  # of each byte in its word; the space behind a word tells its length
    byte = mix(joined.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + mix(np.full(1, seed, np.uint64)))
    word = mix(np.add.reduceat(byte, to[:-1]))
    out = np.zeros(len(left), np.uint64)
    for k in range(shingle):
        place = left + k
        inside = place < right
        out = np.where(inside, mix(out) ^ word[np.minimum(place, len(word) - 1)], out)
    return mix(out)


def ones(h: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many hashes of each group have each bit (group, bit). Each byte of a sum counts one bit of at most 255 hashes;
    larger groups are added up from such parts."""
    parts = -(-count // 255)
    first = np.cumsum(parts) - parts
    starts = ranges(begin * 0, parts) * 255 + np.repeat(begin, parts)
    out = np.empty((len(begin), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        out[:, k::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    return out


def _slices(at: np.ndarray, group: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of consecutive documents of the group with up to `most` hashes (a longer document alone)."""
    i = 0
    while i < len(group):
        j = i + 1
        while j < len(group) and at[group[j] + 1] - at[group[i]] <= most:
            j += 1
        yield i, j
        i = j


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each row's whole text. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = simhash_batch(batch.column(1))[:, 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(rows, run, "doc_id long, fp long")


# --- vantage-point trees over 32-bit halves -----------------------------------------------------------------------


def _distance(x: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint32(point)).astype(np.int16)


def fit_tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple | None:
    """A vantage-point tree (point, radius, inner, outer) over uint32 halves; None is a shard."""
    if depth <= 0 or len(x) < 2:
        return None
    best = None
    for point in x[rng.integers(0, len(x), 8)]:  # the widest spread of distances prunes best
        many = np.bincount(_distance(x, point), minlength=34)
        up_to, seen = np.cumsum(many), np.flatnonzero(many)
        radius = min(int(np.searchsorted(up_to, (len(x) + 1) // 2)), int(seen[-1]) - 1)  # the median, or just below the largest
        if radius < seen[0]:
            continue
        lost = many[radius] + many[radius + 1] + abs(2 * up_to[radius] - len(x)) / 2
        if best is None or lost < best[0]:
            best = (lost, int(point), radius)
    if best is None:
        return None
    _, point, radius = best
    inner = _distance(x, point) <= radius
    return point, radius, fit_tree(x[inner], depth - 1, rng), fit_tree(x[~inner], depth - 1, rng)


def route(tree: tuple | None, x: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes of x, whether it lives there): one home each, and the shards its ball of radius `reach` touches."""
    stack = [(tree, 1, np.arange(len(x)), np.ones(len(x), bool))]
    while stack:
        node, shard, at, home = stack.pop()
        if not len(at):
            continue
        if node is None:
            yield shard, at, home
            continue
        point, radius, inner, outer = node
        d = _distance(x[at], point)
        into, beyond = d - reach <= radius, d + reach > radius
        stack.append((inner, 2 * shard, at[into], home[into] & (d[into] <= radius)))
        stack.append((outer, 2 * shard + 1, at[beyond], home[beyond] & (d[beyond] > radius)))


def _links(v: np.ndarray, h: np.ndarray, fps: np.ndarray, half: np.ndarray, reach: int, most_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between two blocks (of places in fps), the smaller place first, and their bits; of a dense block a forest."""
    i, j = np.nonzero(np.bitwise_count(half[v][:, None] ^ half[h][None, :]) <= reach)
    i, j = v[i], h[j]
    apart = i != j
    i, j = np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart])
    bits = sum((np.bitwise_count(fps[i, k] ^ fps[j, k]).astype(np.int32) for k in range(fps.shape[1])), np.zeros(len(i), np.int32))
    near = bits <= most_bits
    found = i[near], j[near], bits[near]
    return found if len(found[0]) <= 4 * (len(v) + len(h)) else forest(*found)


def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The labels (the first place of each group) after links between places."""
    while len(u):
        np.minimum.at(label, u, v)
        np.minimum.at(label, v, u)
        while True:  # each place's root
            up = label[label]
            if (up == label).all():
                break
            label = up
        u, v = label[u], label[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return label


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links that connect the same of n places: each place with the first one it reaches, unless it is that itself."""
    label = joined(np.arange(n), u, v)
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def forest(u: np.ndarray, v: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of the minimum spanning forest of the places they link: whatever the number of bits at which links are cut, it connects
    the same places as all links do. Of equal bits the smaller places count as nearer."""
    order = np.lexsort((v, u, bits))
    u, v, bits = u[order], v[order], bits[order]
    places, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y, n = ends[: len(u)], ends[len(u) :], len(places)
    label, open_, chosen = np.arange(n), np.arange(len(u)), np.zeros(len(u), bool)
    while len(open_):
        a, b = label[x[open_]], label[y[open_]]
        apart = a != b
        open_, a, b = open_[apart], a[apart], b[apart]
        best = np.full(n, len(u))  # each group's nearest link to another
        np.minimum.at(best, a, open_)
        np.minimum.at(best, b, open_)
        pick = np.unique(best[best < len(u)])
        chosen[pick] = True
        label = joined(label, label[x[pick]], label[y[pick]])
    return u[chosen], v[chosen], bits[chosen]


def shard_forest(fps: np.ndarray, home: np.ndarray, part: int, reach: int, most_bits: int, width: int = HALF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forest (places in fps, bits) of all links between the fingerprints (place, lane) that live in a shard and those and
    all that visit it."""
    rng = np.random.default_rng(0)
    half = block_of(fps, part, width)
    none = np.zeros(0, np.int64)
    found, held = [(none, none, none)], 0
    stack = [(np.flatnonzero(home), np.arange(len(fps)))]
    reduce = lambda: forest(*(np.concatenate(x) for x in zip(*found)))
    while stack:
        h, v = stack.pop()
        if not len(h) or not len(v):
            continue
        node = fit_tree(half[h], 1, rng) if len(h) > LEAF else None
        if node is None:
            step = max(1, (1 << 20) // min(len(h), 4096))
            for j in range(0, len(h), 4096):
                for i in range(0, len(v), step):
                    found.append(_links(v[i : i + step], h[j : j + 4096], fps, half, reach, most_bits))
                    held += len(found[-1][0])
                    if held > MOST_LINKS:
                        found = [reduce()]
                        held = len(found[0][0])
            continue
        point, radius, _, _ = node
        dh, dv = _distance(half[h], point), _distance(half[v], point)
        stack.append((h[dh <= radius], v[dv - reach <= radius]))
        stack.append((h[dh > radius], v[dv + reach > radius]))
    return reduce()


def shard_links(fps: np.ndarray, home: np.ndarray, part: int, reach: int, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places in fps) that connect the fingerprints (place, lane) that live in a shard and all that visit it as
    all their pairs do."""
    u, v, _ = shard_forest(fps, home, part, reach, most_bits)
    return spanning(u, v, len(fps))


def block_of(fps: np.ndarray, part: int, width: int) -> np.ndarray:
    """The bits of fingerprints (place, lane) that a part's trees see; a lane has as many parts as fit into it."""
    lane, place = divmod(part, 64 // width)
    return ((fps[:, lane] >> np.uint64(width * place)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def halves(fps: np.ndarray, part: int) -> np.ndarray:
    return block_of(fps, part, HALF)


def _lanes(column: pd.Series, lanes: int) -> np.ndarray:
    """Fingerprints (place, lane) from longs, or from binary ones of several lanes."""
    flat = column.to_numpy(np.int64).view(np.uint64) if lanes == 1 else np.frombuffer(b"".join(column), np.uint64)
    return flat.reshape(-1, lanes)


def fingerprint_links(distinct: DataFrame, most_bits: int = MAX_BITS, lanes: int = 1) -> DataFrame:
    """(u, v, bits) links between the `node`s of the distinct fingerprints `fp` (long, or binary if of several lanes): of each
    shard a spanning set (one lane), or a minimum spanning forest, of all pairs that differ in at most `most_bits` bits, and by at
    most 1 in some block. (For one lane and 3 bits the second follows.)"""
    spark = distinct.sparkSession
    total, width = distinct.count(), HALF if lanes == 1 else THIRD
    parts = lanes * (64 // width)
    shards = max(1, total / (SHARD if lanes == 1 else WIDE_SHARD))
    rows = min(MOST_SAMPLE, max(SAMPLE, int(SAMPLE_A_SHARD * shards)))
    sample = _lanes(distinct.orderBy(F.xxhash64(F.lit(7), "fp"), "fp").limit(rows).select("fp").toPandas()["fp"], lanes)
    depth = max(0, int(np.ceil(np.log2(shards))))
    reach = 1
    rng = np.random.default_rng(11)
    trees = spark.sparkContext.broadcast([fit_tree(block_of(sample, p, width), depth, rng) for p in range(parts)])  # at most as many nodes as the sample has rows, a part

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            fps = _lanes(batch["fp"], lanes)
            for part, tree in enumerate(trees.value):
                for shard, at, home in route(tree, block_of(fps, part, width), reach):
                    yield batch.iloc[at].assign(part=part, shard=shard, home=home)[["part", "shard", "node", "fp", "home"]]

    def links(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")  # so that a group of copies has the same first node in each part, and the same links
        fps, home = _lanes(group["fp"], lanes), group["home"].to_numpy(bool)
        u, v, bits = shard_forest(fps, home, int(key[0]), reach, most_bits, width)
        if lanes == 1:
            u, v = spanning(u, v, len(fps))
            bits = np.zeros(len(u), np.int64)
        node = group["node"].to_numpy(np.int64)
        tidy()
        return pd.DataFrame({"u": node[u], "v": node[v], "bits": bits})

    dealt = distinct.select("node", "fp").mapInPandas(deal, f"part int, shard long, node long, fp {distinct.schema['fp'].dataType.simpleString()}, home boolean")
    return dealt.groupBy("part", "shard").applyInPandas(links, "u long, v long, bits int").distinct()


def bits_of(similarity: float, bits: int) -> tuple[float, float]:
    """In how many of so many bits the fingerprints of texts of a similarity (Jaccard) and equal length differ: mean and standard deviation."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits * share, math.sqrt(bits * share * (1 - share))


def _alike(known: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The `pairs` (u, v) of nodes that share at least that part of their distinct shingles; known is (node, shingles)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    left = pairs.select("u", "v").join(known.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = left.join(known.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return stored(in_arrow(both.select("u", "v", "a", "b"), compare, "u long, v long"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, lanes: int = LANES) -> DataFrame:
    """`docs` with one row of each group of near copies: the row with the smallest id (none is the largest), of equal ones the first
    by a hash of all columns. Rows that are equal in all columns are one row then.

    Two texts are near copies if at least `similarity` of all their distinct shingles of `shingle` words are in both; groups are what such
    pairs connect. Pairs are found through fingerprints, most but not all of them (measured in the README); those found are compared
    by their shingles, but for fingerprints so near that the similarity can't be less. Null and empty texts are one group. Very long
    texts are texts like others, and columns may have any names. No rows give no rows.
    """
    one, two, copies, key1, key2, node_ = unused(docs, "_mark1", "_mark2", "_copies", "_key1", "_key2", "_node")
    both = [one, two]
    marks = [F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in docs.columns]).alias(m) for k, m in enumerate(both)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = simhash_batch(batch.column(3), shingle, SEED, lanes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in fp], pa.binary())], ["m1", "m2", "id", "fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shingle_sets(batch.column(1), shingle), pa.binary())], ["node", "shingles"])

    marked = docs.select("*", *marks)
    texts = marked.select(F.col(one).alias("m1"), F.col(two).alias("m2"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = stored(in_arrow(texts, run, "m1 long, m2 long, id long, fp binary"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "m1", "m2")
    distinct = stored(rows.groupBy("fp").agg(F.min(order).alias("first")).withColumn("node", F.monotonically_increasing_id()))
    mean, spread = bits_of(similarity, 64 * lanes)
    links = stored(fingerprint_links(distinct, round(mean + WIDER * spread), lanes))
    sure, rest = links.where(F.col("bits") <= mean - SURE * spread).select("u", "v"), links.where(F.col("bits") > mean - SURE * spread)
    # Each text's nearest first: what they connect needs no other link. Then those between what is still apart.
    ends = rest.select(F.explode(F.array("u", "v")).alias("node"), F.struct("bits", "u", "v").alias("link"))
    nearest = stored(ends.groupBy("node").agg(F.min("link").alias("link")).select("link.u", "link.v").distinct())
    asked = rest.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    first_rows = distinct.join(asked, "node").select(F.col("first.m1").alias(key1), F.col("first.m2").alias(key2), F.col("node").alias(node_))
    found = marked.join(small(stored(first_rows)), (F.col(one) == F.col(key1)) & (F.col(two) == F.col(key2))).select(F.col(node_).alias("node"), F.col(f"`{text_col}`").alias("text"))
    known = stored(in_arrow(found, sets, "node long, shingles binary").dropDuplicates(["node"]))
    good = sure.unionByName(_alike(known, nearest, similarity))
    groups = small(stored(connected_components(good)))
    of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    open_ = rest.select("u", "v").join(nearest, ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left")
    open_ = stored(open_.where(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v"))
    if not open_.isEmpty():
        groups = stored(connected_components(good.unionByName(_alike(known, open_, similarity))))
    grouped = distinct.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    firsts = grouped.groupBy("group").agg(F.min("first").alias("kept"))
    # The rows to drop are fewer than the others as a rule; where they are few, no text is shuffled.
    of_row = rows.join(grouped.join(firsts, "group").select("fp", F.col("kept.m1").alias("k1"), F.col("kept.m2").alias("k2")), "fp")
    dropped = stored(of_row.where("m1 <> k1 or m2 <> k2").select(F.col("m1").alias(one), F.col("m2").alias(two)).distinct())
    equal = stored(rows.groupBy(F.col("m1").alias(one), F.col("m2").alias(two)).agg(F.count("*").alias(copies)).where(F.col(copies) > 1).select(*both))
    kept = marked.join(small(dropped), both, "left_anti")
    if not equal.isEmpty():
        equal = small(equal)
        kept = kept.join(equal, both, "left_anti").unionByName(kept.join(equal, both, "left_semi").dropDuplicates(both))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row: documents are linked if their fingerprints differ in at most `most_bits`
    bits (3 at most, as one half then differs in 1 at most), and component_id is the smallest doc_id reachable through links.

    Null and empty texts have fingerprint 0 and are linked like any other; a null doc_id counts in its group but is
    never its smallest; repeated rows give repeated rows; other columns are left out; an empty table gives no rows.
    """
    if most_bits > MAX_BITS:
        raise ValueError(f"at most {MAX_BITS} bits")
    rows = stored(fingerprints(docs, id_col, text_col))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = stored(fingerprint_links(distinct.select(F.col("fp").alias("node"), "fp"), most_bits))
    groups = connected_components(links)
    group_of = distinct.join(groups, distinct["fp"] == groups["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("group")
    )
    group_of = stored(group_of)
    first = group_of.groupBy("group").agg(F.min("first_id").alias("component_id"))
    return rows.join(group_of.join(first, "group").select("fp", "component_id"), "fp")


def op4_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents, with the smallest doc_id of each."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_vptree": op4_simhash_vptree}
ORACLES: dict[str, str] = {}
