"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit verification.

Texts are sequences of words, A-Z lower-cased. A document is contaminated by an item of n words if some stretch of it is
within n / 5 word edits of the item. The CGK random walk embeds edit distance into Hamming distance: reading a sequence,
it writes the current word and moves on or stays by a random bit that depends on the step and the word, so two sequences
fall back into step soon after an edit. Each table walks anew and samples a few positions of the embedding; a window that
agrees with the item on a table's sample makes a candidate, and the edit distance decides.

Two walks that have come apart often meet again too late on long windows, so long items are cut into segments of at most
SEGMENT words: of a match with e edits, one of m segments has e / m edits at most, and windows of the segment's size look for
it. How many tables a size needs follows from a simulation of its largest distance, by deletions, insertions, replacements
and all of them, with the very tables that are used then: as many as find RECALL of the planted pairs of each kind.

Few windows walk: a stretch within e edits of an item holds at least n - 2 - 3e of the item's word trigrams (the q-gram
lemma; short items go by pairs or single words, where that bound is below 1), and those with fewer cannot match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._anchors import mix, ranges
from ._anchors import word_hashes as hashes_of
from ._spark import in_arrow, table
from ._text import doc_chunks, string_bytes, words

SIMILARITY = 0.8
#: Share of the pairs at the largest distance that the tables of a size have to find, sampled positions a table, words of a
#: segment, tables at most, and pairs of a kind in the simulation.
RECALL, SAMPLED, SEGMENT, MOST_TABLES, PAIRS = 0.999, 2, 16, 128, 300
#: Sizes of grams, the most selective first.
GRAMS = (3, 2, 1)
#: Words of items broadcast together; more items are looked for in several passes.
MOST_WORDS = 2_000_000
#: Cells of a verification's table row held together.
CELLS = 1 << 16
#: Walks held together.
WALKS = 1 << 16
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of its words one after another, where each row begins) for chunks of a string column."""
    data, offsets = string_bytes(pc.ascii_lower(column))
    for a, b in doc_chunks(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = words(part, offsets[a : b + 1] - offsets[a])
        yield a, hashes_of(part, starts, ends) | np.uint64(1), first


def grams(w: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the runs of q words; runs of different lengths hash apart."""
    out = np.full(max(0, len(w) - q + 1), np.uint64(q))
    for k in range(q):
        out = mix(out * _STEP + w[k : len(w) - q + 1 + k])
    return out


def allowed(n: np.ndarray | int, similarity: float = SIMILARITY):
    """Word edits that a match of an item of n words may have."""
    return np.floor(np.asarray(n) * (1 - similarity) + 1e-9).astype(np.int64)


def embed(windows: np.ndarray, tables: int) -> np.ndarray:
    """Samples (row, table) of the CGK embeddings of windows (rows of word hashes; 0 is past the end)."""
    count, n = windows.shape
    rng = np.random.default_rng(n)
    sampled = np.stack([rng.permutation(np.arange(2 * n) < min(SAMPLED, 2 * n)) for _ in range(MOST_TABLES)])[:tables]
    salts = rng.integers(1, 2**63, (2 * n, MOST_TABLES, 1), np.uint64)[:, :tables]
    flat = np.concatenate((windows, np.zeros((count, 1), np.uint64)), axis=1).ravel()
    base = np.arange(count) * (n + 1)
    out, at = np.zeros((tables, count), np.uint64), np.zeros((tables, count), np.int64)
    for j in range(2 * n):  # all tables walk at once
        word = flat[base + at]
        use = np.flatnonzero(sampled[:, j])
        out[use] = mix(out[use] * _STEP + word[use] + np.uint64(1))
        at = np.minimum(at + ((word ^ salts[j]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(np.int64), n)
    return out.T


@lru_cache(None)
def tables_for(size: int, edits: int, recall: float = RECALL) -> int:
    """Tables that find `recall` of windows at exactly so many edits from a segment, for each kind of edits."""
    if not edits:
        return 1
    rng = np.random.default_rng(size)
    need = 1
    for kind in ("delete", "insert", "replace", "mixed"):
        words_ = rng.integers(1, 2**63, (PAIRS, 2, size + edits), np.uint64)
        segment, window = words_[:, 0, :size], np.zeros((PAIRS, size), np.uint64)
        for i in range(PAIRS):
            out, fresh = segment[i].tolist(), words_[i, 1].tolist()
            for at in sorted(rng.choice(size, edits, replace=False).tolist(), reverse=True):
                how = ("delete", "insert", "replace")[rng.integers(3)] if kind == "mixed" else kind
                out[at : at + (how != "insert")] = [] if how == "delete" else [fresh.pop()]
            window[i] = (out + fresh)[:size]
        agree = embed(segment, MOST_TABLES) == embed(window, MOST_TABLES)
        found = np.sort(np.where(agree.any(axis=1), agree.argmax(axis=1), MOST_TABLES))
        need = max(need, int(found[math.ceil(recall * PAIRS) - 1]) + 1)
    if need > MOST_TABLES:
        raise ValueError(f"{MOST_TABLES} tables don't find {recall:.1%} of segments of {size} words with {edits} edits; ask for a higher similarity")
    return need


class Segments:
    """The samples of an item's segments: (where it begins, samples) of each."""

    def __init__(self, item: np.ndarray, edits: int):
        cuts = np.linspace(0, len(item), -(-len(item) // SEGMENT) + 1).astype(np.int64)
        self.edits, self.parts = edits, []
        for a, b in zip(cuts, cuts[1:]):
            tables = tables_for(int(b - a), edits // (len(cuts) - 1))
            self.parts.append((int(a), int(b - a), embed(item[None, a:b], tables)[0]))


class Items:
    """The items of one pass: their words, and which items hold a gram."""

    def __init__(self, ids: list, texts: list, similarity: float):
        self.ids, self.words = [], []
        for a, w, first in word_hashes(pa.array(texts, pa.string())):
            for i in np.flatnonzero(np.diff(first)):
                self.ids.append(ids[a + i])
                self.words.append(w[first[i] : first[i + 1]])
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edits = allowed(self.sizes, similarity)
        self.segments = [Segments(w, int(e)) for w, e in zip(self.words, self.edits)]
        shares = np.stack([self.sizes - q + 1 - q * self.edits for q in GRAMS])  # grams that a match holds at least
        kind = (shares > 0).argmax(axis=0)
        self.q = np.array(GRAMS)[kind]
        self.need = np.maximum(1, np.take_along_axis(shares, kind[None, :], axis=0)[0]) if len(self.words) else self.sizes
        self.lists = []
        for q in GRAMS:
            some = np.flatnonzero(self.q == q)
            if not len(some):
                continue
            held = [np.unique(grams(self.words[i], q)) for i in some]
            flat, item = np.concatenate(held), np.repeat(some, [len(h) for h in held])
            order = np.lexsort((item, flat))
            known, begin = np.unique(flat[order], return_index=True)
            sieve = np.zeros(1 << 22, bool)
            sieve[known >> np.uint64(42)] = True
            self.lists.append((q, known, item[order], np.append(begin, len(order)), sieve))

    def regions(self, w: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, first start, last start) of all windows that hold enough grams of an item; none overlap."""
        found = [(np.zeros(0, np.int64),) * 4]
        for q, known, items, begin, sieve in self.lists:
            g = grams(w, q)
            hits = np.flatnonzero(sieve[g >> np.uint64(42)])
            where = np.minimum(np.searchsorted(known, g[hits]), len(known) - 1)
            true = known[where] == g[hits]
            hits, where = hits[true], where[true]
            row = np.searchsorted(bounds, hits, "right") - 1
            inside = hits + q <= bounds[row + 1]
            hits, where, row = hits[inside], where[inside], row[inside]
            # The hits, once for each item that has the gram.
            many = begin[where + 1] - begin[where]
            pos, row, item = np.repeat(hits, many), np.repeat(row, many), items[ranges(begin[where], many)]
            order = np.lexsort((pos, item, row))
            pos, row, item = pos[order], row[order], item[order]
            last = np.arange(len(pos)) + self.need[item] - 1
            ok = last < len(pos)
            last = np.minimum(last, len(pos) - 1)
            width = self.sizes[item] + self.edits[item] - q + 1
            ok &= (row[last] == row) & (item[last] == item) & (pos[last] - pos < width)
            at = np.flatnonzero(ok)
            low, high = np.maximum(pos[last[at]] - width[at] + 1, bounds[row[at]]), pos[at]
            found.append((row[at], item[at], low, high))
        row, item, low, high = map(np.concatenate, zip(*found))
        if not len(row):
            return row, item, low, high
        # Both ends ascend with the position of an item's hits in a row: each begins where the one before ended.
        same = (row[1:] == row[:-1]) & (item[1:] == item[:-1])
        low[1:] = np.where(same, np.maximum(low[1:], high[:-1] + 1), low[1:])
        open_ = low <= high
        row, item, low, high = row[open_], item[open_], low[open_], high[open_]
        fresh = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] != high[:-1] + 1))
        at = np.flatnonzero(fresh)
        row, item, low, high = row[at], item[at], low[at], high[np.append(at[1:], len(fresh)) - 1]
        # Long ones in pieces, so that those verified together are of like lengths.
        most = 2 * (self.sizes[item] + self.edits[item])
        pieces = -(-(high - low + 1) // most)
        k = ranges(np.zeros(len(pieces), np.int64), pieces)
        row, item, low, high, most = (np.repeat(x, pieces) for x in (row, item, low, high, most))
        return row, item, low + k * most, np.minimum(high, low + (k + 1) * most - 1)

    def candidates(self, w: np.ndarray, bounds: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which regions hold a window that agrees with a segment of their item on a table's sample."""
        near = np.zeros(len(row), bool)
        shapes: dict[tuple, list] = {}
        for r, (i, a, b) in enumerate(zip(item.tolist(), low.tolist(), high.tolist())):
            own = self.segments[i]
            for begin, size, samples in own.parts:
                shapes.setdefault((size, len(samples)), []).append((r, max(a, a + begin - own.edits), b + begin + own.edits, samples))
        for (size, tables), asked in sorted(shapes.items()):
            asked = [x for x in asked if not near[x[0]]]
            if not asked:
                continue
            first, last = (np.array([x[k] for x in asked]) for k in (1, 2))
            count = last - first + 1
            which, start = np.repeat(np.arange(len(asked)), count), ranges(first, count)
            samples = np.stack([x[3] for x in asked])
            region = np.array([x[0] for x in asked])
            step = max(1, WALKS // tables)
            for k in range(0, len(start), step):
                index = start[k : k + step, None] + np.arange(size)
                inside = index < bounds[row[region[which[k : k + step]]] + 1, None]
                windows = np.where(inside, w[np.minimum(index, len(w) - 1)], np.uint64(0))
                hit = (embed(windows, tables) == samples[which[k : k + step]]).any(axis=1)
                near[region[which[k : k + step][hit]]] = True
        return near

    def matches(self, w: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, item, first word in the row, edits) of the nearest match of each region that has one."""
        row, item, low, high = self.regions(w, bounds)
        if not len(row):
            return
        near = self.candidates(w, bounds, row, item, low, high)
        row, item, low, high = row[near], item[near], low[near], high[near]
        for n in np.unique(self.sizes[item]):
            some = np.flatnonzero(self.sizes[item] == n)
            e = int(self.edits[item[some[0]]])
            some = some[np.argsort(high[some] - low[some], kind="stable")]
            span = high[some] - low[some] + n + e
            step = max(1, CELLS // int(span[-1]))
            for s in range(0, len(some), step):
                part = some[s : s + step]
                index = low[part, None] + np.arange(int(span[min(s + step, len(some)) - 1]))
                stretch = np.where(index < bounds[row[part] + 1, None], w[np.minimum(index, len(w) - 1)], np.uint64(0))
                edits = start_distances(np.stack([self.words[m] for m in item[part]]), stretch)
                edits = np.where(index <= high[part, None], edits, 1 << 20)
                best = edits.argmin(axis=1)
                least = edits[np.arange(len(part)), best]
                good = least <= e
                yield row[part][good], item[part][good], (low[part] + best - bounds[row[part]])[good], least[good].astype(np.int64)


def start_distances(items: np.ndarray, stretches: np.ndarray) -> np.ndarray:
    """Word edits between each item and the nearest part of its stretch that begins at each word (0 is past the end)."""
    count, n = items.shape
    back = stretches[:, ::-1]
    step = np.arange(back.shape[1] + 1, dtype=np.int32)
    old = np.zeros((count, len(step)), np.int32)
    for i in range(n):
        new = np.empty_like(old)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(old[:, 1:] + 1, old[:, :-1] + (back != items[:, n - 1 - i, None]))
        old = np.minimum.accumulate(new - step, axis=1) + step
    return old[:, :0:-1]


def edit_distance(items: np.ndarray, stretches: np.ndarray) -> np.ndarray:
    """Word edits between each item and the nearest beginning of its stretch (0 is past the end of the document)."""
    return np.minimum(start_distances(items, stretches)[:, 0], items.shape[1])


def _passes(benchmark: DataFrame, item_id_col: str, item_text_col: str, similarity: float) -> Iterator:
    """The items, as broadcasts of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // (6 * MOST_WORDS)))
    for k in range(passes):
        some = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).collect()
        yield spark.sparkContext.broadcast(Items([r.id for r in some], [r.text for r in some], similarity))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, edits): for each row and item the nearest match, the first of equals.

    Null and empty texts match nothing; items of under 5 words match only as they are. Repeated
    documents and items each have their rows; null ids are passed on. Other columns are left out. No documents or no items
    give no rows. The items are broadcast in passes of bounded size. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for shared in _passes(benchmark, item_id_col, item_text_col, similarity):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            if not known.words:
                return
            for batch in batches:
                ids = batch.column(0)
                for a, w, bounds in word_hashes(batch.column(1)):
                    found = list(known.matches(w, bounds))
                    if not found:
                        continue
                    row, item, start, edits = map(np.concatenate, zip(*found))
                    order = np.lexsort((start, edits, item, row))
                    row, item, start, edits = row[order], item[order], start[order], edits[order]
                    best = np.ones(len(row), bool)
                    best[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
                    row, item, start, edits = row[best], item[best], start[best], edits[best]
                    columns = [ids.take(pa.array(row + a)), pa.array([known.ids[i] for i in item], pa.int64()), pa.array(start), pa.array(edits)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start_word", "edits"])

        found = in_arrow(rows, run, "doc_id long, item_id long, start_word long, edits long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` whose text holds no item, with all their columns. Each row is judged by its own text, whatever its
    id; null and empty texts stay."""
    place = docs.columns.index(text_col)
    for shared in _passes(benchmark, item_id_col, item_text_col, similarity):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for a, w, bounds in word_hashes(batch.column(place)) if known.words else ():
                    for row, *_ in known.matches(w, bounds):
                        keep[row + a] = False
                yield batch.filter(pa.array(keep))

        docs = in_arrow(docs, run, docs.schema)
    return docs


def op5_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, where and with how many word edits."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_cgk_decontamination": op5_cgk_decontamination}
ORACLES: dict[str, str] = {}
