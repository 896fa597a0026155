"""Source divergence audit: how far the term frequencies of a language's sources are apart, on run-length columns.

Each language's vocabulary is put into an order that brings terms with equal counts together (by all occurrences, then by
a digest of the counts in each source), and cut into blocks. In a block each source is a column of frequencies; most
neighbours in it are equal, so a column is a short list of runs. A pair of sources intersects the boundaries of its two
lists of runs and adds up the difference times the run's length. Blocks and tiles of sources make the tasks: no task holds
a whole vocabulary or all sources of a language. All arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import in_arrow, small, stored, table
from ._text import as_strings, doc_chunks, stretches, string_bytes

MIN_DOCS, PRIOR, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: Terms of a block and sources of a tile: a task has at most two tiles' rows of one block.
BLOCK, TILE = 16_384, 64


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of ASCII letters and bytes beyond ASCII of each document, A-Z lower-cased, and the document of each."""
    lower = data | ((data - np.uint8(65) < 26).astype(np.uint8) << 5)
    inside = (lower - np.uint8(97) < 26) | (lower >= 128)
    starts, ends = stretches(inside, offsets)
    return as_strings(lower, inside, ends - starts), np.searchsorted(offsets, starts, "right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) sums of each stretch of documents, and one row without a term for each of its groups."""
    for batch in batches:
        for a, b in doc_chunks(string_bytes(batch.column(2))[1], 4 << 20):
            part = batch.slice(a, b - a)
            groups = pa.Table.from_arrays([part.column(0), part.column(1)], ["lang", "source"])
            keys = groups.group_by(["lang", "source"]).aggregate([])
            codes = pc.index_in(_pair(groups), _pair(keys)).to_numpy()
            data, offsets = string_bytes(part.column(2))
            found, doc = terms(data, offsets)
            coded = found.dictionary_encode()
            code, width = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
            in_doc, times = np.unique(doc * width + code, return_counts=True)
            cell, back = np.unique(codes[in_doc // width] * width + in_doc % width, return_inverse=True)
            n = np.bincount(back, times, len(cell)).astype(np.int64)
            docs = np.bincount(back, minlength=len(cell)).astype(np.int64)
            group, term = cell // width, cell % width
            none = pa.array(np.zeros(len(keys), np.int64))
            for at, word, x, y in ((pa.array(group), coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs)), (pa.array(np.arange(len(keys))), pa.nulls(len(keys), pa.string()), none, none)):
                named = keys.take(at).combine_chunks()
                yield pa.RecordBatch.from_arrays([_flat(named["lang"]), _flat(named["source"]), word, x, y], ["lang", "source", "term", "n", "docs"])


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _pair(groups: pa.Table) -> pa.Array:
    """One string for each (lang, source); the length of the first tells where it ends."""
    lang, source = _flat(groups["lang"]), _flat(groups["source"])
    return pc.binary_join_element_wise(pc.utf8_length(lang).cast(pa.string()), lang, source, ":")


def source_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row with a null term for each
    group. Nulls count as empty strings; a group has its rows even if no text has a term."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    parts = in_arrow(rows, _counted, "lang string, source string, term string, n long, docs long")
    return stored(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(count: Column, of: Column, terms_: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (of + PRIOR * terms)), in decimals of up to 38 digits; null if there are no terms."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    return F.when(terms_ > 0, F.call_function("div", top, (of + PRIOR * terms_).cast("decimal(20,0)")).cast("long") + 1)


def runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of the runs of equal neighbours."""
    starts = np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1))
    return starts, column[starts]


def run_difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """The sum of |x - y| over two columns of so many places, given as runs."""
    bounds = np.union1d(a[0], b[0])
    x = a[1][np.searchsorted(a[0], bounds, "right") - 1]
    y = b[1][np.searchsorted(b[0], bounds, "right") - 1]
    return int((np.abs(x - y) * np.diff(bounds, append=length)).sum())


def _tile_pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(one, other, f) for the pairs of sources of two tiles in a block. rows (source, tile, pos, p, base, size): terms that occur in
    a source, and for each source a row without a pos; base is the frequency of terms that don't occur."""
    _, _, left, right = key
    size = int(rows["size"].iloc[0])
    seen = np.unique(rows["pos"].dropna().to_numpy(np.int64))  # places that no column here has are one more run, at the end
    columns: dict[int, list] = {int(left): [], int(right): []}
    for source, own in rows.groupby("source", sort=True):
        column = np.full(min(size, len(seen) + 1), own["base"].iloc[0], np.int64)
        there = own[own["pos"].notna()]
        column[np.searchsorted(seen, there["pos"].to_numpy(np.int64))] = there["p"].to_numpy(np.int64)
        columns[int(own["tile"].iloc[0])].append((source, runs(column)))
    out = []
    for i, (one, a) in enumerate(columns[int(left)]):
        for other, b in columns[int(right)][i + 1 if left == right else 0 :]:
            out.append((one, other, run_difference(a, b, size)))
    return pd.DataFrame(out, columns=["one", "other", "f"])


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, most_terms: int = MOST_TERMS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) of each group (lang, source) of docs. Part `pair`: item is another source of the
    language, value the sum of the differences of all kept terms' frequencies; part `term`: the terms that the source has
    more often than its language, by how much, the first `most_terms`. Ties go to the first item by its UTF-8 bytes.

    A language keeps the terms that at least `min_docs` of its documents have; a frequency is 1 + floor(10^9 * (count + 5)
    / (all counts + 5 * kept terms)). Null text, lang and source count as empty. Repeated rows count each; long texts are
    read whole; other columns are left out, whatever their names. A language of one source has no pairs, one without kept
    terms pairs of value 0 and no terms; no rows give no rows.
    """
    counts = source_terms(docs, text_col, lang_col, source_col)
    digest = F.sum(F.xxhash64("source", "n").cast("decimal(20,0)")).cast("string")
    vocabulary = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), digest.alias("digest")).where(F.col("docs") >= min_docs)
    # The order that clusters equal counts; ids rise with it, and a block is a stretch of one partition.
    vocabulary = stored(vocabulary.drop("docs"))
    order = ("lang", "total", "digest", "term")
    placed = vocabulary.repartitionByRange(*order).sortWithinPartitions(*order).select("lang", "term", "total", F.monotonically_increasing_id().alias("pos"))
    placed = stored(placed.withColumn("block", F.expr(f"pos div {block}")))
    kept = stored(counts.where("term is not null").join(placed, ["lang", "term"]).select("lang", "source", "term", "n", "total", "pos", "block"))

    of_lang = placed.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_sum"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    groups = counts.where("term is null").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    sources = counts.where("term is null").groupBy("lang").agg(F.count("*").alias("sources"))
    zero = F.lit(0).cast("long")
    groups = groups.join(sources, "lang").select("lang", "source", F.coalesce("sum", zero).alias("sum"), F.coalesce("terms", zero).alias("terms"), F.coalesce("lang_sum", zero).alias("lang_sum"), F.ceil(F.col("sources") / tile).cast("int").alias("tiles"))
    groups = groups.withColumns({"base": F.coalesce(_share(F.lit(0).cast("long"), F.col("sum"), F.col("terms")), zero), "tile": F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")})
    groups = small(stored(groups))

    rated = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("sum"), F.col("terms")))
    q = _share(F.col("total"), F.col("lang_sum"), F.col("terms"))
    more = rated.withColumn("value", F.col("p") - q).where("value > 0")
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most_terms)

    blocks = placed.groupBy("lang", "block").agg(F.count("*").alias("size"))
    columns = blocks.join(groups, "lang").select("lang", "block", "size", "source", "tile", "tiles", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("p"), "base")
    cells = rated.join(small(blocks), ["lang", "block"]).select(*columns.columns)
    dealt = columns.unionByName(cells).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("lang", "block", F.least("tile", "with").alias("left"), F.greatest("tile", "with").alias("right"), "source", "tile", "pos", "p", "base", "size")
    parts = dealt.groupBy("lang", "block", "left", "right").applyInPandas(lambda key, rows: _tile_pairs(key, rows).assign(lang=key[0])[["lang", "one", "other", "f"]], "lang string, one string, other string, f long")
    sums = parts.groupBy("lang", "one", "other").agg(F.sum("f").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item")))).alias("e"), "value")
    # Languages without kept terms have no blocks: their pairs are all 0.
    bare = groups.where("terms = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", zero.alias("value"))
    pairs = both.select("lang", "e.source", "e.item", "value").unionByName(none)
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked)).select(*top.columns)
    return pairs.unionByName(top)


def op13_run_length_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of all pairs of sources of a language, and each source's most typical terms, over all documents."""
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op13_run_length_divergence": op13_run_length_divergence}
ORACLES = {
    "op13_run_length_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM v GROUP BY 1),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // CAST(s.n + 5 * l.v AS HUGEINT) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (v.total + 5)) // CAST(l.n + 5 * l.v AS HUGEINT) AS q
      FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term JOIN l ON l.lang = g.lang JOIN s ON s.lang = g.lang AND s.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM k WHERE part = 'pair' OR rank <= 50"""
}
