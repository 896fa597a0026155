"""Substring dedup by bytes: hash-compared suffix sort.

Strings of 400 bytes that start at two places or more are removed. Anchors (see _anchors) bring the places together that
may share one. The contexts of an anchor are sorted by their suffixes from the anchor on, in a mergesort whose
comparisons find the common extension of two suffixes by binary search on prefix polynomial hashes; neighbours in that
order share the longest extensions, and going outward from each the common extensions to both sides tell which strings
repeat. What the hashes claim is verified on the bytes. Each chunk of documents sorts its own contexts so and settles
those that are equal; the contexts that are left, one for each distinct text, are sorted by shards of anchors, and one that
stands in several chunks meets itself there.
"""

from __future__ import annotations

import copy
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ._anchors import _TABLES, PrefixHash, PrimeHash, Repeats, covered, remove_repeats
from ._spark import table

WINDOW, GRAM = 400, 200
_digest = xxhash.xxh3_64_intdigest


class Contexts:
    """Contexts over one array of bytes: prefix hashes, and where each begins, ends and has its anchor."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, anchor: np.ndarray, hashes: PrefixHash | None = None):
        self.data, self.begin, self.end, self.anchor = data, begin, end, anchor
        self.hash = PrefixHash(_TABLES[0][data]) if hashes is None else hashes
        self.prime = PrimeHash(_TABLES[1][data])

    @classmethod
    def of(cls, snippets: list[bytes], left: np.ndarray) -> Contexts:
        ends = np.cumsum([len(s) for s in snippets])
        begin = np.append(0, ends[:-1])
        return cls(np.frombuffer(b"".join(snippets), np.uint8), begin, ends, begin + left)

    def take(self, which: np.ndarray) -> Contexts:
        out = copy.copy(self)
        out.begin, out.end, out.anchor = self.begin[which], self.end[which], self.anchor[which]
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray, verify: bool = False) -> np.ndarray:
        """Length of the common extension of the suffixes from the anchors of i and j."""
        return self._extent(self.anchor[i], self.anchor[j], np.minimum(self.end[i] - self.anchor[i], self.end[j] - self.anchor[j]), 1, verify)

    def back(self, i: np.ndarray, j: np.ndarray, verify: bool = False) -> np.ndarray:
        """Length of the common extension to the left of the anchors."""
        return self._extent(self.anchor[i], self.anchor[j], np.minimum(self.anchor[i] - self.begin[i], self.anchor[j] - self.begin[j]), -1, verify)

    def _extent(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, way: int, verify: bool) -> np.ndarray:
        low, high = np.zeros(len(x), np.int64), most.copy()
        mid = most  # most comparisons are of equal texts
        while (open_ := low < high).any():
            (u, v), (s, t) = ((x, x + mid), (y, y + mid)) if way > 0 else ((x - mid, x), (y - mid, y))
            equal = (self.hash.of(u, v) == self.hash.of(s, t)) & (self.prime.of(u, v) == self.prime.of(s, t))
            low, high = np.where(open_ & equal, mid, low), np.where(open_ & ~equal, mid - 1, high)
            mid = (low + high + 1) // 2
        if verify:  # a collision can only claim too much
            for k in range(0, len(x), 512):
                s = slice(k, k + 512)
                step = np.arange(low[s].max(initial=0))
                inside = step < low[s, None]
                shift = step if way > 0 else -1 - step
                u, v = (np.where(inside, p[s, None] + shift, 0) for p in (x, y))
                wrong = inside & (self.data[u] != self.data[v])
                low[s] = np.where(wrong.any(axis=1), wrong.argmax(axis=1) if len(step) else 0, low[s])
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether i's suffix sorts before j's; a prefix sorts first, equal ones by index."""
        n = self.ahead(i, j)
        x, y = self.anchor[i] + n, self.anchor[j] + n
        x_over, y_over = x >= self.end[i], y >= self.end[j]
        last = len(self.data) - 1
        less = self.data[np.minimum(x, last)] < self.data[np.minimum(y, last)]
        return np.where(x_over & y_over, i < j, np.where(x_over | y_over, x_over, less))


def suffix_order(c: Contexts, group: np.ndarray) -> np.ndarray:
    """Contexts ordered by their suffixes within each group (group is ascending): a bottom-up mergesort, all merges of a
    level at once, each element placed by binary search in the sibling run."""
    n = len(group)
    order = np.arange(n)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    first, count = np.repeat(begin, size), np.repeat(size, size)
    place = np.arange(n) - first
    run = 1
    while n and run < count.max():
        own = place // run
        sibling = own ^ 1
        low = np.minimum(sibling * run, count)
        floor, high = low.copy(), np.minimum(low + run, count)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            other, me = order[first[open_] + mid], order[first[open_] + place[open_]]
            smaller = c.before(other, me)
            low[open_] = np.where(smaller, mid + 1, low[open_])
            high[open_] = np.where(smaller, high[open_], mid)
        to = (own & ~1) * run + place % run + low - floor
        merged = np.empty_like(order)
        merged[first + to] = order
        order = merged
        run *= 2
    return order


def repeated_windows(c: Contexts, group: np.ndarray, nearest: np.ndarray, furthest: np.ndarray, window: int) -> list[np.ndarray]:
    """Parts (context, first, last): windows that begin `first`..`last` bytes left of the anchor stand in another context.
    nearest and furthest are the windows a context has to judge."""
    order = suffix_order(c, group)
    n = len(order)
    if n < 2:
        return []
    same = group[order[1:]] == group[order[:-1]]
    next_to = np.zeros(n - 1, np.int64)
    at = np.flatnonzero(same)
    next_to[at] = c.ahead(order[at], order[at + 1])
    done = np.zeros((n, 2), np.int64)  # windows found so far as one run from `nearest` and one from `furthest`
    out = []
    for way in (1, -1):
        who = np.arange(n)
        reach = np.full(n, np.iinfo(np.int64).max)
        step = 0
        while who.size:
            step += 1
            to = who + way * step
            ok = (to >= 0) & (to < n)
            who, to, reach = who[ok], to[ok], reach[ok]
            reach = np.minimum(reach, next_to[to - 1 if way > 0 else to])
            i = order[who]
            ok = window - reach <= furthest[i]  # even the window furthest to the left would be too short a match
            ok &= ~((done[i, 0] >= 1) & (done[i, 0] > furthest[i] - nearest[i]))
            who, to, reach, i = who[ok], to[ok], reach[ok], i[ok]
            if not who.size:
                break
            j = order[to]
            left = c.back(i, j)
            some = np.flatnonzero(np.maximum(window - reach, nearest[i]) <= np.minimum(left, furthest[i]))
            if some.size:
                a, b = i[some], j[some]
                right_true, left_true = c.ahead(a, b, verify=True), c.back(a, b, verify=True)
                lo, hi = np.maximum(window - right_true, nearest[a]), np.minimum(left_true, furthest[a])
                good = lo <= hi
                out.append(np.stack((a[good], lo[good], hi[good]), axis=1))
                whole = a[good][(lo[good] <= nearest[a[good]]) & (hi[good] >= furthest[a[good]])]
                done[whole, 0] = furthest[whole] - nearest[whole] + 1
    return out


class Bytes:
    """A chunk of documents as bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.data, self.bounds, self.window, self.gram = data, offsets, window, gram
        self.units = _TABLES[0][data]
        self.view = memoryview(np.ascontiguousarray(data))

    def _digests(self, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        view = self.view
        return np.fromiter((_digest(view[i:j], seed) for i, j in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))

    def anchor_ids(self, at: np.ndarray) -> np.ndarray:
        return self._digests(at, at + self.gram, 1)

    def class_ids(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._digests(begin, end, 2)

    def settle(self, c: dict[str, np.ndarray], _ids: np.ndarray, piece: int, hashes: PrefixHash) -> tuple[np.ndarray, ...]:
        """Sort the suffixes of the contexts whose anchor stands several times in the piece. Neighbours that extend to both
        sides over all of either, verified on the bytes, are equal: all of them repeat, and one stands for them later."""
        _, group, count = np.unique(c["anchor"], return_inverse=True, return_counts=True)
        some = np.flatnonzero(count[group] > 1)
        some = some[np.argsort(group[some], kind="stable")]
        done = np.zeros(len(group), bool)
        if not len(some):
            return done, some, some, some
        lo, end, a = c["lo"][some], c["hi"][some] + self.window, c["a"][some]
        near = Contexts(self.data[piece : piece + len(hashes.sums) - 1], lo - piece, end - piece, a - piece, hashes)
        order = suffix_order(near, group[some])
        i, j = order[:-1], order[1:]
        alike = (group[some[i]] == group[some[j]]) & (a[i] - lo[i] == a[j] - lo[j]) & (end[i] - a[i] == end[j] - a[j])
        at = np.flatnonzero(alike)
        i, j = i[at], j[at]
        equal = (near.ahead(i, j, verify=True) == end[i] - a[i]) & (near.back(i, j, verify=True) == a[i] - lo[i])
        i, j = i[equal], j[equal]
        done[some[j]] = True
        repeats = np.unique(np.concatenate((i, j)))
        return done, c["doc"][some[repeats]], lo[repeats], end[repeats]


def _resolver(window: int):
    def resolve(anchor, _doc, left, right, several, snippets: list[bytes]):
        """Windows of each class that stand in another class, or in the class itself where it has several places."""
        c = Contexts.of(snippets, left)
        which = np.concatenate((np.arange(len(left)), np.flatnonzero(several)))
        which = which[np.argsort(anchor[which], kind="stable")]
        _, group = np.unique(anchor[which], return_inverse=True)
        parts = repeated_windows(c.take(which), group, right[which], left[which], window)
        found = np.concatenate([np.zeros((0, 3), np.int64), *parts])
        cls = which[found[:, 0]]
        windows = tuple(np.unique(np.stack((cls, left[cls] - found[:, 2], left[cls] - found[:, 1]), axis=1), axis=0).T)
        return windows, windows

    return resolve


def _windows(window: int):
    return lambda snippet, count: [snippet[i : i + window] for i in range(count)]


def _finish(text: np.ndarray, spans: np.ndarray) -> dict:
    gone = covered(len(text), spans)
    kept = text[~gone].tobytes()
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    return {"n_bytes": len(text), "n_removed": int(gone.sum()), "n_spans": runs, "kept": kept, "kept_sha256": hashlib.sha256(kept).hexdigest()}


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_classes: int = 2048, with_text: bool = True, scan: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept) for each row; kept is what is left of the
    UTF-8 bytes, which may begin or end inside a character.

    A byte is removed if a string of `window` bytes covers it that also starts anywhere else, the same document
    included; matches stay inside a document and are judged on the input. Null texts count as empty. Rows without
    doc_id are judged and are sources like any other. Rows that repeat a doc_id are places of their own, each with its own
    text. Other columns are left out; no rows give no rows. `scan` says that docs only reads files, which needs no copy of
    the texts. `window` is at most 1023.
    """
    fields = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.binary()} if with_text else {})
    finish = _finish if with_text else lambda text, spans: {k: v for k, v in _finish(text, spans).items() if k != "kept"}
    gram = max(1, window // 2)
    spec = Repeats(window, gram, lambda data, offsets: Bytes(data, offsets, window, gram), lambda t, cuts: [t[a:b].tobytes() for a, b in cuts], _resolver(window), _windows(window), finish, pa.schema(fields), False, most_classes)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return remove_repeats(docs, spec, ddl, id_col, text_col, scan)


def op8_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document left after repeated 400-byte strings are removed, as counts and a digest."""
    return remove_repeated_strings(table(spark, sf_dir, "documents"), with_text=False, scan=True)


QUERIES = {"op8_suffix_sort": op8_suffix_sort}
ORACLES: dict[str, str] = {}
