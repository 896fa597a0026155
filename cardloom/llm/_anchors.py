"""Repeated windows of a corpus, found through content-defined anchors; shared by the two substring operators.

A document is a sequence of units (bytes or words). Each window of K units picks as its anchor the k-gram inside it that
has the smallest hash, the rightmost of equals. Equal windows pick the same anchor at the same offset wherever they
stand, so all that can repeat meets under its anchor, with about 2 / (K - k + 2) rows a unit instead of one. The windows
that share one anchor form its *context*; contexts of equal content form a class, named by 64-bit digests of the anchor's
and of the context's own text. Anchors only bring together what may repeat; the operator's own method, its automata or
its sorted suffixes, says on the text which windows do.

The work:

1. each chunk of documents settles the repeats inside it by that method and sends on one row for a class (so a passage
   that a third of the corpus holds arrives once a chunk, not once a document). What it settled goes along in the same
   rows, so nothing rests on two scans being cut into the same batches;
2. windows over the anchor tell which anchors hold several classes, or a class of several documents; that is stored;
3. of these the text of one context a class is fetched, and the resolver runs the method over the classes of whole
   anchors. The places of a class follow its text in the same sorted rows, as a stream, and get what was found in it;
4. anchors with more than `most_classes` classes are dealt out anew by single windows, which then are contexts of their
   own, with the window's digest for an anchor, and go to the same resolver;
5. the removed spans are gathered by document and joined to the texts.

Both joins to the texts need them dealt out by document; Spark reuses that exchange, so texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import in_arrow, small, stored
from ._text import doc_chunks, string_bytes

BASE = 0x9E3779B97F4A7C15
LOW = np.uint64((1 << 22) - 1)
#: Units looked at together; longer documents are cut, with the windows at the cut in one of the pieces.
PIECE = 1 << 20
#: Bytes of texts that settle their repeats together.
CHUNK = 1 << 21
#: Bytes of rows resolved together in a task, besides one anchor's.
BUFFER = 2_000_000
_TABLES = np.random.default_rng(20_011).integers(1, 2**63, (2, 256), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... (count[0] of them), low[1], ..."""
    return np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())


_known_powers: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse."""
    if not _known_powers or len(_known_powers[0]) < n:
        _known_powers.clear()
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
            p[0] = 1
            _known_powers.append(np.multiply.accumulate(p))
    return _known_powers


class PrefixHash:
    """Prefix polynomial hashes of a sequence (mod 2^64): the hash of any stretch from two look-ups. Some sequences can
    be built to collide, so these hashes choose anchors and guide comparisons, and never decide that texts are equal."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def rolling(self, k: int) -> np.ndarray:
        return (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]


PRIME = 2**32 - 5
_prime_powers: list[np.ndarray] = []


class PrimeHash:
    """Prefix polynomial hashes modulo a prime, beside PrefixHash: what is built to collide there doesn't here."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        if not _prime_powers or len(_prime_powers[0]) < n + 1:
            _prime_powers.clear()
            for base in (BASE % PRIME, pow(BASE, -1, PRIME)):
                p = np.ones(1, np.uint64)
                while len(p) < max(1 << 16, n + 1):
                    p = np.concatenate((p, p * np.uint64(pow(base, len(p), PRIME)) % np.uint64(PRIME)))
                _prime_powers.append(p)
        self.down = _prime_powers[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values % np.uint64(PRIME) * _prime_powers[0][:n] % np.uint64(PRIME), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) % np.uint64(PRIME) * self.down[starts] % np.uint64(PRIME)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, by both kinds of polynomials over its bytes."""
    two = [kind(table_[data]).of(starts, ends) for kind, table_ in zip((PrefixHash, PrimeHash), _TABLES)]
    return mix(two[0] ^ mix(two[1] + (ends - starts).astype(np.uint64)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    y = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def contexts(units: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Iterator[tuple[int, PrefixHash, dict[str, np.ndarray]]]:
    """(where the piece begins, its prefix hashes, its contexts) for the pieces of documents that lie one after another.

    Contexts are doc (index), a (the anchor), lo and hi (first and last window), as units counted from the chunk's begin."""
    n, w = len(units), window - gram + 1
    doc_of = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    for s in range(0, max(0, n - window + 1), PIECE):
        e = min(n, s + PIECE + window - 1)
        hashes = PrefixHash(units[s:e])
        grams = hashes.rolling(gram)
        key = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        key &= ~LOW
        key |= LOW - np.arange(len(key), dtype=np.uint64)
        chosen = (LOW - (sliding_min(key, w) & LOW)).astype(np.int64)
        inside = doc_of[s : e - window + 1] == doc_of[s + window - 1 : e]
        cut = np.flatnonzero((chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1])) + 1
        lo = np.concatenate(([0], cut))
        hi = np.concatenate((cut, [len(chosen)])) - 1
        lo, hi = lo[inside[lo]], hi[inside[lo]]
        yield s, hashes, {"doc": doc_of[lo + s], "a": chosen[lo] + s, "lo": lo + s, "hi": hi + s}


@dataclass(frozen=True)
class Repeats:
    """What counts as a repeat, and how the text of contexts is taken and resolved."""

    window: int
    gram: int
    #: bytes and offsets of documents -> a chunk: .units (a hash each), .bounds, .anchor_ids(a), .class_ids(lo, end), and
    #: .settle(contexts, documents' ids, where the piece begins, its hashes) -> (contexts settled, doc, start, end)
    chunk: Callable
    cut_text: Callable  # bytes of a document, [(start, end) in units] -> list of bytes
    #: anchors, docs, left, right, several, snippets of classes -> (class, first, last) windows to remove, for the class's
    #: first document and for its other ones
    resolve: Callable
    windows: Callable  # a snippet, how many windows it has -> their texts
    finish: Callable  # bytes of a document, spans -> a row of the result
    result: pa.Schema
    later_only: bool  # only windows that begin in a smaller document count (else anywhere else)
    most_classes: int = 2048


ROWS = "anchor long, ctx long, doc long, variant long, place long, settled boolean"


def place_of(a, left, right):
    """The anchor's place and the windows furthest and nearest to its left, in one long."""
    return ((a << 10) + left << 10) + right


def _leading(spec: Repeats) -> Callable:
    """Rows (anchor, ctx, doc, variant, place, settled): a context for each class and document that the chunk hasn't settled.

    Rows with `settled` are spans to remove: ctx is where they start, place where they end, anchor only deals them out."""

    def rows(anchor, ctx, doc, variant, place, settled: bool) -> pa.RecordBatch:
        columns = [anchor, ctx, doc, variant, place, np.full(len(doc), settled)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "ctx", "doc", "variant", "place", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = string_bytes(batch.column(2))
            for a, b in doc_chunks(offsets, CHUNK):
                own, chunk = ids[a:b], spec.chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for s, hashes, c in contexts(chunk.units, chunk.bounds, spec.window, spec.gram):
                    if not len(c["doc"]):
                        continue
                    c["anchor"] = chunk.anchor_ids(c["a"])
                    c["ctx"] = chunk.class_ids(c["lo"], c["hi"] + spec.window)
                    done, doc, start, end = chunk.settle(c, own, s, hashes)
                    base, left = chunk.bounds[c["doc"]], ~done
                    place = place_of(c["a"] - base, c["a"] - c["lo"], c["a"] - c["hi"])[left]
                    at = c["doc"][left]
                    yield rows(c["anchor"][left].view(np.int64), c["ctx"][left].view(np.int64), own[at], variants[a + at], place, False)
                    if len(doc):
                        base = chunk.bounds[doc]
                        doc, variant, start, end = (x.to_numpy() for x in _spans(own[doc], variants[a + doc], start - base, end - base).columns)
                        dealt = mix(doc.view(np.uint64) * np.uint64(BASE) + start.view(np.uint64)).view(np.int64)
                        yield rows(dealt, start, doc, variant, end, True)

    return run


def _spans(doc: np.ndarray, variant: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans of the same document that touch become one row."""
    order = np.lexsort((start, variant, doc))
    doc, variant, start, end = doc[order], variant[order], start[order], end[order]
    if len(doc):
        base = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1]))) << 40
        reach = np.maximum.accumulate(end + base)
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (start[1:] + base[1:]) > reach[:-1]
        at = np.flatnonzero(fresh)
        doc, variant, start, end = doc[at], variant[at], start[at], np.append(reach[at[1:] - 1], reach[-1]) - base[at]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, variant, start, end)], ["doc", "variant", "start", "end"])


_SNIPPETS = pa.schema({"anchor": pa.int64(), "cls": pa.int32(), "doc": pa.int64(), "variant": pa.int64(), "place": pa.int64(), "several": pa.bool_(), "snippet": pa.binary()})
_SNIPPET_DDL = "anchor long, cls int, doc long, variant long, place long, several boolean, snippet binary"


def _fetch(spec: Repeats) -> Callable:
    """Cut the asked contexts out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            lists = batch.column("asked")
            many = np.diff(lists.offsets.to_numpy())
            asked = lists.flatten()
            place = asked.field("place").to_numpy()
            a, left, right = place >> 20, (place >> 10) & 1023, place & 1023
            cuts = list(zip((a - left).tolist(), (a - right + spec.window).tolist()))
            snippets, at = [], 0
            for i, n in enumerate(many.tolist()):
                snippets += spec.cut_text(data[offsets[i] : offsets[i + 1]], cuts[at : at + n])
                at += n
            which = pa.array(np.repeat(np.arange(len(many)), many))
            columns = [asked.field("anchor"), asked.field("cls"), batch.column("doc").take(which), batch.column("variant").take(which), asked.field("place"), asked.field("several"), pa.array(snippets, pa.binary())]
            out = pa.RecordBatch.from_arrays(columns, schema=_SNIPPETS)
            for k in range(0, len(out), 10_000):
                yield out.slice(k, 10_000)

    return run


def _resolving(spec: Repeats) -> Callable:
    """Resolve contexts that come ordered by anchor, of each anchor first the classes' texts (kind 0), then their places.

    Whole anchors are resolved some at a time. Of an anchor with very many places only the texts are kept, and its places
    stream past them."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        texts, places = rows.filter(pc.equal(rows["kind"], 0)), rows.filter(pc.equal(rows["kind"], 1))
        anchor, cls, doc, place = (texts[c].to_numpy() for c in ("anchor", "cls", "doc", "place"))
        left = (place >> 10) & 1023
        several = texts["several"].to_numpy()
        first, others = spec.resolve(anchor, doc, left, place & 1023, several, texts["snippet"].to_pylist())
        number = {key: i for i, key in enumerate(zip(anchor.tolist(), cls.tolist()))}
        m_doc, m_variant, m_place = (places[c].to_numpy() for c in ("doc", "variant", "place"))
        of = np.fromiter((number[key] for key in zip(places["anchor"].to_numpy().tolist(), places["cls"].to_numpy().tolist())), np.int64, len(m_doc))
        is_first = m_doc == doc[of]
        found = [(np.zeros(0, np.int64),) * 4]
        for mask, (cls, low, high) in ((is_first, first), (~is_first, others)):
            order = np.argsort(cls, kind="stable")
            cls, low, high = cls[order], low[order], high[order]
            at = np.flatnonzero(mask)
            begin = np.searchsorted(cls, of[at])
            count = np.searchsorted(cls, of[at], "right") - begin
            part, member = ranges(begin, count), np.repeat(at, count)
            base = (m_place[member] >> 20) - ((m_place[member] >> 10) & 1023)
            found.append((m_doc[member], m_variant[member], base + low[part], base + high[part] + spec.window))
        return _spans(*map(np.concatenate, zip(*found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, most = 0, BUFFER
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < most:
                continue
            rows = pa.Table.from_batches(held)
            anchors = rows["anchor"].to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))
            if cut:
                yield out(rows.slice(0, cut))
                rows = rows.slice(cut)
            elif rows["kind"][-1].as_py():
                yield out(rows)
                rows = rows.filter(pc.equal(rows["kind"], 0))
            rows = rows.combine_chunks()
            held, size = rows.to_batches(), rows.nbytes
            most = size + BUFFER
        if held:
            yield out(pa.Table.from_batches(held))

    return run


def _window_rows(spec: Repeats) -> Callable:
    """The windows of classes of hot anchors: two digests and the text of each, in order."""
    names = ["anchor", "cls", "ones", "twos", "snippets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"ones": [], "twos": [], "snippets": []}
            for place, snippet in zip(batch.column("place").to_pylist(), batch.column("snippet").to_pylist()):
                texts = spec.windows(snippet, ((place >> 10) & 1023) - (place & 1023) + 1)
                for name, seed in (("ones", 3), ("twos", 4)):
                    out[name].append(np.array([xxhash.xxh3_64_intdigest(t, seed) for t in texts], np.uint64).view(np.int64))
                out["snippets"].append(texts)
            columns = [batch.column("anchor"), batch.column("cls"), *(pa.array(out[n], pa.list_(pa.int64())) for n in names[2:4]), pa.array(out["snippets"], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _finishing(spec: Repeats) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            ids, all_spans = batch.column("id").to_pylist(), batch.column("spans").to_pylist()
            rows = []
            for i, (doc, spans) in enumerate(zip(ids, all_spans)):
                pairs = np.array([(s["start"], s["end"]) for s in spans or ()], np.int64).reshape(-1, 2)
                rows.append({"doc_id": doc, **spec.finish(data[offsets[i] : offsets[i + 1]], pairs)})
            yield pa.RecordBatch.from_pylist(rows, schema=spec.result)

    return run


def covered(length: int, spans: np.ndarray) -> np.ndarray:
    """Which of `length` units some span covers."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, np.clip(spans[:, 0], 0, length), 1)
    np.add.at(steps, np.clip(spans[:, 1], 0, length), -1)
    return np.cumsum(steps[:length]) > 0


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, scan: bool) -> DataFrame:
    """(id, doc, variant, text) of each row: doc and variant together name a text. variant is 0 but for the rows whose id
    is null or stands at several texts, where it is a hash of the text (and doc another one, where there is no id)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not scan:
        texts = stored(texts)
    hashed = F.xxhash64("text")
    ids = texts.where("id is not null").groupBy("id").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high"))
    unclear = stored(ids.where("low <> high").select(F.col("id").alias("unclear")))
    own = F.xxhash64(F.lit(1), "text").bitwiseOR(F.lit(1))
    if unclear.isEmpty():
        variant = F.when(F.col("id").isNull(), own).otherwise(F.lit(0))
    else:
        texts = texts.join(small(unclear), F.col("id") == F.col("unclear"), "left")
        variant = F.when(F.col("id").isNull() | F.col("unclear").isNotNull(), own).otherwise(F.lit(0))
    return texts.select("id", F.coalesce("id", hashed).alias("doc"), variant.cast("long").alias("variant"), "text")


def _compared(rows: DataFrame, spec: Repeats) -> DataFrame:
    """`rows` with the number of their class at its anchor, their rank in the class, whether it has several documents (or
    places), and how many classes the anchor has."""
    by_anchor, by_class = W.partitionBy("settled", "anchor"), W.partitionBy("settled", "anchor", "ctx")
    seen = rows.repartition("anchor").withColumn("rank", F.row_number().over(by_class.orderBy("doc", "variant", "place")))
    several = F.max("doc").over(by_class) > F.min("doc").over(by_class) if spec.later_only else F.count("*").over(by_class) > 1
    seen = seen.withColumn("several", several).withColumn("cls", F.sum((F.col("rank") == 1).cast("int")).over(by_anchor.orderBy("ctx", "doc", "variant", "place")).cast("int"))
    return seen.withColumn("classes", F.max("cls").over(by_anchor))


def _resolved(rows: DataFrame, known: DataFrame, spec: Repeats) -> DataFrame:
    """(doc, variant, start, end): the spans to remove, from rows of contexts (steps 2 to 4)."""
    settled = F.col("settled")
    verdicts = stored(
        _compared(rows, spec).where("settled or several or classes > 1").select(
            F.when(~settled, F.col("anchor")).alias("anchor"), F.when(~settled, F.col("cls")).alias("cls"), F.when(settled, F.col("ctx")).alias("start"),
            "doc", "variant", "place", "settled", "several", (~settled & (F.col("rank") == 1)).alias("asks"), (~settled & (F.col("classes") > spec.most_classes)).alias("hot"),
        )
    )
    columns = ["anchor", "cls", "doc", "variant", "place", "several"]

    def texts_of(which: str) -> DataFrame:  # with the columns that the end needs, so that both use one exchange
        asked = verdicts.where(f"asks and {which}").groupBy("doc", "variant").agg(F.collect_list(F.struct("anchor", "cls", "place", "several")).alias("asked"))
        return in_arrow(known.join(asked, ["doc", "variant"]).select("id", "doc", "variant", "text", "asked"), _fetch(spec), _SNIPPET_DDL)

    def found(both: DataFrame) -> DataFrame:
        return in_arrow(both.repartition("anchor").sortWithinPartitions("anchor", "kind"), _resolving(spec), "doc long, variant long, start long, end long")

    spans = verdicts.where("settled").select("doc", "variant", "start", F.col("place").alias("end"))
    places = verdicts.where("not settled and not hot").select(F.lit(1).alias("kind"), *columns, F.lit(None).cast("binary").alias("snippet"))
    spans = spans.unionByName(found(texts_of("not hot").select(F.lit(0).alias("kind"), *columns, "snippet").unionByName(places)))
    if verdicts.where("hot").isEmpty():
        return spans
    windows = in_arrow(texts_of("hot"), _window_rows(spec), "anchor long, cls int, ones array<long>, twos array<long>, snippets array<binary>")
    first = F.shiftright("place", 20) - F.shiftright("place", 10).bitwiseAND(1023)
    each = verdicts.where("hot").join(windows, ["anchor", "cls"]).select("doc", "variant", first.alias("first"), F.posexplode(F.arrays_zip("ones", "twos", "snippets")).alias("n", "w"))
    single = each.select(F.col("w.ones").alias("anchor"), F.col("w.twos").alias("ctx"), "doc", "variant", F.shiftleft(F.col("first") + F.col("n"), 20).alias("place"), F.lit(False).alias("settled"), F.col("w.snippets").alias("snippet"))
    kinds = F.explode(F.when(F.col("rank") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("kind")
    again = _compared(single, spec).where("several").select(kinds, *columns, "snippet")
    return spans.unionByName(found(again.withColumn("snippet", F.when(F.col("kind") == 0, F.col("snippet")))))


def remove_repeats(docs: DataFrame, spec: Repeats, ddl: str, id_col: str, text_col: str, scan: bool) -> DataFrame:
    """One row a document: what `spec.finish` makes of its text and the spans to remove. Anything but a scan of files
    (`scan` false) is written to the shared folder first, as it is read several times."""
    texts = keyed_texts(docs, id_col, text_col, scan)
    known = texts.where("id is not null") if spec.later_only else texts
    leading = in_arrow(known.select("doc", "variant", "text"), _leading(spec), ROWS)
    spans = _resolved(leading, known, spec).groupBy("doc", "variant").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    done = known.join(spans, ["doc", "variant"], "left").select("id", "text", "spans")
    if spec.later_only:
        done = done.unionByName(texts.where("id is null").select("id", "text", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans")))
    return in_arrow(done, _finishing(spec), ddl)
