"""Substring dedup by words: repeated-phrase automata.

Windows of 13 words that also start in a document with a smaller id are removed. Anchors (see _anchors) confirm which
passages may recur. Each chunk of documents compiles the passages that recur inside it into an Aho-Corasick automaton
and streams its documents through; each shard of anchors compiles what recurs across chunks and streams the passages
of the shard, one for each distinct text, whose places share what is found. A phrase occurs only where its anchor does, so
every occurrence meets every automaton that could match it, and a word is removed only where an automaton found a phrase.

Automata read words as short runs of characters, a run for each distinct word of the chunk or shard, which keeps their
nodes few and their alphabet small.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ._anchors import Repeats, covered, mix, ranges, remove_repeats, word_hashes
from ._spark import table
from ._text import words

WINDOW, GRAM = 13, 5
_digest = xxhash.xxh3_64_intdigest


def spelled(codes: np.ndarray) -> tuple[str, int]:
    """Numbers of words as one string, and the characters a word has: digits of base 128, apart by their position."""
    digits = max(1, -(-int(codes.max(initial=0)).bit_length() // 7))
    out = np.empty((len(codes), digits), "<u4")
    for k in range(digits):
        out[:, k] = 0x100 + 0x80 * k + ((codes >> (7 * k)) & 127)
    return out.tobytes().decode("utf-32-le"), digits


class Words:
    """A chunk of documents: its words joined by one space, and a hash for each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        starts, ends, self.bounds = words(data, offsets)
        self.window = window
        lengths = ends - starts
        self.to = np.concatenate(([0], np.cumsum(lengths + 1)))
        keep = np.repeat(starts - self.to[:-1], lengths + 1) + np.arange(self.to[-1])
        self.joined = data[np.minimum(keep, max(0, len(data) - 1))] if len(starts) else np.zeros(0, np.uint8)
        self.joined[self.to[1:] - 1] = 32
        self.view = memoryview(self.joined)
        self.units = word_hashes(data, starts, ends)

    def numbers(self, of: np.ndarray) -> np.ndarray:
        """A number for each distinct word among the marked ones; the others have 0."""
        at = np.flatnonzero(of)
        length = self.to[at + 1] - self.to[at]
        ends = np.concatenate(([0], np.cumsum(length)))
        array = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(self.joined[ranges(self.to[at], length)])])
        out = np.zeros(len(of), np.int64)
        out[at] = array.dictionary_encode().indices.to_numpy(zero_copy_only=False) + 1
        return out

    def anchor_ids(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(min(GRAM, self.window)):
            out = mix(out + self.units[at + k])
        return out

    def class_ids(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        view, lo, hi = self.view, self.to[begin].tolist(), (self.to[end] - 1).tolist()
        return np.fromiter((_digest(view[i:j], 2) for i, j in zip(lo, hi)), np.uint64, len(lo))

    def settle(self, c: dict[str, np.ndarray], ids: np.ndarray, _piece: int, _hashes) -> tuple[np.ndarray, ...]:
        """Stream the documents through the automaton of the chunk's recurring passages. Returns which contexts have all
        their windows in smaller documents of the chunk, and where the windows found lie."""
        n = len(c["doc"])
        doc = ids[c["doc"]]
        order = np.lexsort((c["a"], doc, c["ctx"], c["anchor"]))
        fresh = np.ones(n, bool)
        fresh[1:] = (c["anchor"][order[1:]] != c["anchor"][order[:-1]]) | (c["ctx"][order[1:]] != c["ctx"][order[:-1]])
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, n))
        later = doc[order] > np.repeat(doc[order[begin]], size)
        recurs = np.logical_or.reduceat(later, begin)
        none = np.zeros(0, np.int64)
        if not recurs.any():
            return np.zeros(n, bool), none, none, none
        met = np.zeros(len(self.bounds), np.int64)
        met[np.unique(c["doc"][order[np.repeat(recurs, size)]])] = 1
        text, digits = spelled(self.numbers(np.repeat(met[:-1], np.diff(self.bounds)) > 0))
        automaton = ahocorasick.Automaton()
        first = order[begin[recurs]]
        for lo, end, source in zip(c["lo"][first].tolist(), (c["hi"][first] + self.window).tolist(), doc[first].tolist()):
            automaton.add_word(text[lo * digits : end * digits], (end - lo, source))
        automaton.make_automaton()
        found: list[tuple[int, int, int]] = []
        for d in np.unique(c["doc"][order[later]]).tolist():
            own, begin = int(ids[d]), int(self.bounds[d])
            for end, (length, source) in automaton.iter(text[begin * digits : int(self.bounds[d + 1]) * digits]):
                if source < own:
                    end = begin + (end + 1) // digits
                    found.append((d, end - length, end))
        if not found:
            return np.zeros(n, bool), none, none, none
        where, start, end = np.array(found, np.int64).T
        steps = np.zeros(len(self.units) + 2, np.int64)
        np.add.at(steps, start, 1)
        np.add.at(steps, end - self.window + 1, -1)
        hit = np.concatenate(([0], np.cumsum(np.cumsum(steps) > 0)))
        return hit[c["hi"] + 1] - hit[c["lo"]] == c["hi"] - c["lo"] + 1, where, start, end


def _words_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, _ = words(text, np.array([0, len(text)]))
    return starts, ends


def _cut(text: np.ndarray, cuts: list[tuple[int, int]]) -> list[bytes]:
    starts, ends = _words_of(text)
    raw, begin, end = text.tobytes(), starts.tolist(), ends.tolist()
    split = [raw[i:j] for i, j in zip(begin, end)]
    return [b" ".join(split[a:b]) for a, b in cuts]


def _resolver(window: int):
    def resolve(anchor, doc, left, right, several, snippets: list[bytes]):
        """Windows of each class that recur: for the class's first document those known from a smaller one, for its other
        documents all."""
        data = np.frombuffer(b" ".join([*snippets, b""]), np.uint8)
        to = np.concatenate(([0], np.flatnonzero(data == 32) + 1))
        array = pa.Array.from_buffers(pa.large_binary(), len(to) - 1, [None, pa.py_buffer(to), pa.py_buffer(data)])
        text, digits = spelled(array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.searchsorted(to, np.cumsum([len(s) + 1 for s in snippets])).tolist()
        begins = [0, *ends[:-1]]
        docs, many = doc.tolist(), several.tolist()
        _, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
        alone = (count[group] == 1).tolist()
        width = window * digits
        known: dict[str, int] = {}
        recurring: set[str] = set()
        for i, (a, b) in enumerate(zip(begins, ends)):
            if alone[i]:
                continue
            for k in range(a * digits, (b - window) * digits + 1, digits):
                phrase = text[k : k + width]
                source = known.setdefault(phrase, docs[i])
                if source != docs[i] or many[i]:
                    recurring.add(phrase)
                    known[phrase] = min(source, docs[i])
        automaton = ahocorasick.Automaton()
        for phrase in recurring:
            automaton.add_word(phrase, (window, known[phrase]))
        for i, (a, b) in enumerate(zip(begins, ends)):
            if alone[i] and many[i] and text[a * digits : b * digits] not in automaton:  # the only class of its anchor recurs as a whole
                automaton.add_word(text[a * digits : b * digits], (b - a, docs[i]))
        first: list[tuple[int, int, int]] = []
        others: list[tuple[int, int, int]] = []
        if len(automaton):
            automaton.make_automaton()
            for i, (a, b) in enumerate(zip(begins, ends)):
                for end, (length, source) in automaton.iter(text[a * digits : b * digits]):
                    last = (end + 1) // digits - window
                    low = last + window - length
                    for found, good in ((first, source < docs[i]), (others, source <= docs[i])):
                        if not good:
                            continue
                        if found and found[-1][0] == i and low <= found[-1][2] + 1:
                            found[-1] = (i, min(low, found[-1][1]), max(last, found[-1][2]))
                        else:
                            found.append((i, low, last))
        return tuple(tuple(np.array(f, np.int64).reshape(-1, 3).T) for f in (first, others))

    return resolve


def _windows(window: int):
    def texts(snippet: bytes, count: int) -> list[bytes]:
        w = snippet.split(b" ")
        return [b" ".join(w[i : i + window]) for i in range(count)]

    return texts


def _finish(text: np.ndarray, spans: np.ndarray) -> dict:
    starts, ends = _words_of(text)
    gone = covered(len(starts), spans)
    raw = text.tobytes()
    keep = ~gone
    kept = b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])
    return {"n_words": len(starts), "n_removed": int(gone.sum()), "kept_text": kept.decode("utf-8"), "kept_sha256": hashlib.sha256(kept).hexdigest()}


def remove_repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_classes: int = 2048, with_text: bool = True, scan: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text) for each row.

    A word is removed if a window of `window` words covers it that also starts in a document with a smaller id; windows
    are judged on the input. Null and empty texts have no words. A row without doc_id comes back whole and is no source, as no
    id is smaller or larger than none. Rows that repeat a doc_id are judged each by its own text, and are no source for one
    another. Other columns are left out; no rows give no rows. `scan` says that docs only reads files, which needs no copy of
    the texts.
    """
    fields = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept_text": pa.string()} if with_text else {})
    finish = _finish if with_text else lambda text, spans: {k: v for k, v in _finish(text, spans).items() if k != "kept_text"}
    spec = Repeats(window, min(GRAM, window), lambda data, offsets: Words(data, offsets, window), _cut, _resolver(window), _windows(window), finish, pa.schema(fields), True, most_classes)
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return remove_repeats(docs, spec, ddl, id_col, text_col, scan)


def op7_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document left after repeated 13-word phrases are removed, as counts and a digest."""
    return remove_repeated_phrases(table(spark, sf_dir, "documents"), with_text=False, scan=True)


QUERIES = {"op7_phrase_automata": op7_phrase_automata}
ORACLES: dict[str, str] = {}
