"""Spelling variant grouping: words one edit apart, by asymmetric q-chunks.

One word contributes two disjoint chunks, its halves; the other contributes its positional grams of the same sizes that
stand within shift one of those places. One edit falls into one half and leaves the other whole: at the same place if it
is the first half or the words are equally long, one place on if it is the second half of the shorter word. So words that
are one edit apart meet under a chunk, and each meeting is verified. Where a chunk brings too many words together, the rest
of those words is halved again, and again, until few are left or a single place is open; this loses no pair.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import in_arrow, small, stored, table
from ._text import as_strings, doc_chunks, stretches, string_bytes

LETTERS, MIN_COUNT, RATIO, MISSPELT = 6, 5, 5, 199
#: A chunk with more comparisons than this is split further.
MOST_COMPARED = 1 << 20
#: Words longer than this many bytes are hashed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> np.uint32(1)) ^ np.uint32(0xEDB88320), row >> np.uint32(1)).astype(np.uint32)
    return row


CRC = _crc_table()


def crc_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """CRC-32 of stretches of bytes, each going on from its seed (the CRC-32 of what comes before)."""
    lengths = ends - starts
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(lengths > LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]], int(seed[i]))
    at = np.flatnonzero(lengths <= LONG)
    at = at[np.argsort(-lengths[at], kind="stable")]
    many = np.searchsorted(-lengths[at], -np.arange(LONG), "left")  # so many words have more than k bytes
    state = seed[at].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    first = starts[at]
    for k in range(int(lengths[at[0]]) if len(at) else 0):
        m = many[k]
        state[:m] = CRC[(state[:m] ^ data[first[:m] + k]) & np.uint32(0xFF)] ^ (state[:m] >> np.uint32(8))
    out[at] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) sums of each stretch of documents (doc_id as text, text)."""
    for batch in batches:
        for a, b in doc_chunks(string_bytes(batch.column(1))[1], 4 << 20):
            part = batch.slice(a, b - a)
            data, offsets = string_bytes(part.column(1))
            lower = data | ((data - np.uint8(65) < 26).astype(np.uint8) << 5)
            lead = lower == 0xC3  # U+00C0 to U+00FF are this byte and one more
            inside = (lower - np.uint8(97) < 26) | lead
            inside[1:] |= lead[:-1]
            starts, ends = stretches(inside, offsets)
            before = np.concatenate(([0], np.cumsum(lead)))
            size = ends - starts - (before[ends] - before[starts])
            some = np.flatnonzero(size >= LETTERS)
            starts, ends, size = starts[some], ends[some], size[some]
            seeds = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in part.column(0).to_pylist()], np.uint32)
            h = crc_of(lower, starts, ends, seeds[np.searchsorted(offsets, starts, "right") - 1])
            wrong = h % MISSPELT == 0
            kept = np.zeros(len(lower) + 1, np.int32)
            np.add.at(kept, starts[~wrong], 1)
            np.add.at(kept, ends[~wrong], -1)
            plain = as_strings(lower, np.cumsum(kept[:-1]) > 0, (ends - starts)[~wrong])
            spelt = []
            for i in np.flatnonzero(wrong & (size > LETTERS)):
                word, at = lower[starts[i] : ends[i]].tobytes().decode(), int(h[i] % size[i])
                spelt.append(word[:at] + word[at + 1 :])
            counts = pa.chunked_array([plain, pa.array(spelt, pa.large_string())]).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], ["word", "n"])


def spelt_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of at least LETTERS code points and min_count occurrences."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return in_arrow(rows, _counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """Rows (word, longer, window) with `key`: the word without the window, which is one of 2^level parts of the shorter word's
    length; of a word that takes the longer one's part the window is one place wider."""
    size = F.length("word") - F.col("longer")
    bound = lambda i: F.shiftright(i.cast("long") * size, level)
    low, high = bound(F.col("window")), bound(F.col("window") + 1)
    rest = F.concat(F.expr("substring(word, 1, _low)"), F.expr("substring(word, _high + longer + 1)"))
    open_ = rows.withColumns({"_low": low.cast("int"), "_high": high.cast("int"), "_size": size})
    return open_.select("word", "longer", "window", F.xxhash64("_size", F.lit(level), "window", rest).alias("key"), (F.col("_high") - F.col("_low") > 1).alias("open"))


def near_words(words: DataFrame, most_compared: int = MOST_COMPARED) -> DataFrame:
    """(a, b), each pair of different words that are one inserted, deleted or replaced code point apart, once."""
    each = words.select("word", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"), F.lit(0).alias("window"))
    level, found = 0, None
    while True:
        level += 1
        halves = each.withColumn("window", F.explode(F.array(F.col("window") * 2, F.col("window") * 2 + 1)))
        rows = stored(_keyed(halves, level))
        sizes = rows.groupBy("key").agg(F.count_if(F.col("longer") == 0).alias("chunks"), F.count("*").alias("all"), F.max("open").alias("open"))
        hot = small(stored(sizes.where(F.col("open") & (F.col("chunks") * F.col("all") > most_compared)).select("key")))
        none = hot.isEmpty()
        light = rows if none else rows.join(hot, "key", "left_anti")
        left = light.where("longer = 0").select("key", F.col("word").alias("a"))
        right = light.select("key", F.col("word").alias("b"), "longer")
        near = F.levenshtein("a", "b", 1) == 1
        pairs = left.join(right, (left["key"] == right["key"]) & ((F.col("longer") == 1) & (F.length("b") == F.length("a") + 1) | (F.length("b") == F.length("a")) & (F.col("longer") == 0) & (F.col("a") < F.col("b"))) & near).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if none:
            return found.distinct()
        each = rows.join(hot, "key", "left_semi").select("word", "longer", "window")


def spelling_groups(words: DataFrame, ratio: int = RATIO, most_compared: int = MOST_COMPARED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of `words` (word, n), each word once.

    form is the near word of largest n (of equal n the first in code-point order), if that n is at least `ratio` times the
    word's, root what following forms comes to. A word without near words has n_near 0, no form and itself as root. No words
    give no rows. Forms grow by `ratio` with each step, so the chains are short and are followed by doubling."""
    words = stored(words)
    pairs = stored(near_words(words, most_compared))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("back"), "near")).alias("best"))
    formed = words.join(best, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.back") >= ratio * F.col("n"), F.lit(False)))
    formed = stored(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("best.near")).alias("form"), F.when(F.col("is_form"), -F.col("best.back")).alias("form_n")))
    most = formed.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, ratio)) + 1)
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        roots = stored(roots)
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """spelling_groups of the words of docs: maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least six code points after
    lower-casing A-Z, that occur `min_count` times. To have misspellings at hand, a run whose CRC-32 with its doc_id is
    divisible by MISSPELT loses one code point.

    A null text has no words, a null doc_id counts as an empty one, repeated rows count each, very long texts are read
    whole; other columns are left out, whatever their names."""
    return spelling_groups(spelt_words(docs, id_col, text_col, min_count), ratio)


def op11_asymmetric_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_asymmetric_chunks": op11_asymmetric_chunks}
ORACLES = {
    "op11_asymmetric_chunks": r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(0, 256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
lengthy AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, length(bytes) // 2), lambda k: CAST(('0x' || substring(bytes, 2 * k + 1, 2)) AS BIGINT)),
             lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), CAST(4294967295 AS BIGINT))) AS h FROM lengthy, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT word, k, substring(word, 1, k) || substring(word, k + 2) AS less FROM w, range(0, 64) r(k) WHERE k < length(word)),
near AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
         UNION SELECT c.word, w.word FROM cut c JOIN w ON c.less = w.word UNION SELECT w.word, c.word FROM cut c JOIN w ON c.less = w.word),
ranked AS (SELECT near.word, near, b.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY b.n DESC, near) AS k FROM near JOIN w b ON near.near = b.word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN near END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n FROM w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
up(word, root, form) AS (SELECT word, word, form FROM formed UNION ALL SELECT up.word, f.word, f.form FROM up JOIN formed f ON up.form = f.word)
SELECT f.word, f.form, up.root, f.n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed f JOIN up ON up.word = f.word AND up.form IS NULL"""
}
