"""Language ID by multilingual mixture inference.

Each language has a character-trigram model of its words, fitted to a bounded sample of labelled rows. A document's words
are drawn from a mixture of languages; expectation-maximisation estimates the proportions, and the set of languages is
chosen by penalised likelihood (BIC): starting from the best single language, the language that raises the penalised
likelihood most is added until none does. The largest proportion of the chosen set names the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._anchors import mix
from ._spark import in_arrow, table
from ._text import doc_chunks, string_bytes, words

#: Labelled rows a language is fitted to, about (drawn by a hash of the id), and bytes of text in a task's batch of counts.
FIT_ROWS = 2_000
#: Buckets of trigrams, most languages, smoothing, rounds of expectation-maximisation.
BUCKETS, MOST_LANGUAGES, SMOOTH, ROUNDS = 1 << 16, 256, 0.05, 25
#: The log-likelihood that one more language has to add, as a share of log(words): BIC has 0.5 for one parameter.
PENALTY = 0.5
_MARKS = " \t.,;:!?|\"'()[]{}<>*-_/\\"


def word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(row, word, count) of the distinct words of each row, and the words: lower-cased, ASCII marks trimmed, with letters
    (or bytes beyond ASCII) and no digit or @."""
    data, offsets = string_bytes(column)
    starts, ends, first = words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    # Words as an Arrow array over the same bytes: separators stay inside, so the gaps are cut out first.
    lengths = ends - starts
    to = np.concatenate(([0], np.cumsum(lengths)))
    keep = np.repeat(starts - to[:-1], lengths) + np.arange(to[-1])
    array = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data[keep])])
    encoded = array.dictionary_encode()
    plain = pc.utf8_lower(pc.ascii_trim(encoded.dictionary, _MARKS))
    good = pc.and_(pc.match_substring_regex(plain, r"\pL"), pc.invert(pc.match_substring_regex(plain, "[0-9@]")))
    again = plain.dictionary_encode()
    code = again.indices.to_numpy(zero_copy_only=False)[encoded.indices.to_numpy(zero_copy_only=False)]
    ok = good.to_numpy(zero_copy_only=False)[encoded.indices.to_numpy(zero_copy_only=False)]
    pair, count = np.unique(row[ok] * len(again.dictionary) + code[ok], return_counts=True)
    return pair // len(again.dictionary), pair % len(again.dictionary), count, again.dictionary


def trigram_buckets(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket of the trigram, bucket of its first two bytes) for each trigram of each word, a blank at either end."""
    data, offsets = string_bytes(dictionary)
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    cuts = offsets + 2 * np.arange(n + 1)
    padded = np.full(cuts[-1], 32, np.uint64)
    at = np.repeat(cuts[:-1] + 1 - offsets[:-1], lengths) + np.arange(len(data))
    padded[at] = data
    word = np.repeat(np.arange(n), lengths)
    begin = np.repeat(cuts[:-1] - offsets[:-1], lengths) + np.arange(len(data))
    two = (padded[begin] << np.uint64(8)) | padded[begin + 1]
    three = mix((two << np.uint64(8)) | padded[begin + 2])
    return word, (three % np.uint64(BUCKETS)).astype(np.int64), two.astype(np.int64)


class Model:
    """Log-probabilities log P(third | first two) of each language, as a table (bucket, language)."""

    def __init__(self, languages: list[str], three: np.ndarray, two: np.ndarray):
        self.languages = languages
        self.three, self.two = np.log(three + SMOOTH).T.copy(), np.log(two + SMOOTH * 64).T.copy()

    def words(self, dictionary: pa.Array) -> np.ndarray:
        """Log-likelihood (word, language)."""
        word, three, two = trigram_buckets(dictionary)
        out = np.zeros((len(dictionary), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(word, self.three[three, k] - self.two[two, k], len(dictionary))
        return out


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = FIT_ROWS) -> Model:
    """Fit to about `rows` labelled rows of each language, of which there may be MOST_LANGUAGES; more are an error. Counts are added
    up on the executors, a row a language."""
    spark = docs.sparkSession
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would outgrow a broadcast")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, 1 << 16)))
    share = {r["lang"]: rows / r["count"] for r in sizes}
    drawn = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1_000_000)) < 1_000_000 * F.element_at(F.create_map(*[F.lit(x) for p in share.items() for x in p]), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                mask = pa.array([x == lang for x in langs])
                _, word, n, dictionary = word_counts(batch.column(0).filter(mask))
                if not len(word):
                    continue
                seen = np.bincount(word, n, len(dictionary))
                at, three, two = trigram_buckets(dictionary)
                known = sums.setdefault(lang, [np.zeros(BUCKETS), np.zeros(1 << 16)])
                known[0] += np.bincount(three, seen[at], BUCKETS)
                known[1] += np.bincount(two, seen[at], 1 << 16)
        for lang, (three, two) in sums.items():
            for kind, values in enumerate((three, two)):
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "kind": [kind] * len(at), "bucket": at, "n": values[at].astype(np.int64)}, schema=pa.schema({"lang": pa.string(), "kind": pa.int32(), "bucket": pa.int64(), "n": pa.int64()}))

    kept = labelled.where(F.col("lang").isin(languages) & drawn).select("text", "lang")
    counts = in_arrow(kept, count, "lang string, kind int, bucket long, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    three, two = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), 1 << 16))
    at = np.searchsorted(languages, counts["lang"].to_numpy(object)) if len(counts) else np.zeros(0, int)
    for kind, into in enumerate((three, two)):
        own = (counts["kind"] == kind).to_numpy()
        into[at[own], counts["bucket"].to_numpy()[own]] = counts["n"].to_numpy()[own]
    return Model(languages, three, two)


def mixtures(row: np.ndarray, count: np.ndarray, loglik: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions (row, language), log-likelihood) of documents given their distinct words (sorted by row)."""
    langs = loglik.shape[1]
    share = np.zeros((rows, langs))
    if not len(row) or not langs:
        return share, np.zeros(rows)
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    docs = row[begin]
    which = np.repeat(np.arange(len(docs)), np.diff(np.append(begin, len(row))))
    top = loglik.max(axis=1)
    lik = np.exp(loglik - top[:, None])
    weight = count[:, None].astype(float)
    total = np.add.reduceat(count, begin).astype(float)
    base = np.add.reduceat(top * count, begin)
    penalty = PENALTY * np.log(np.maximum(total, 2))

    single = np.add.reduceat(loglik * weight, begin)
    best = single.argmax(axis=1)
    chosen = np.zeros((len(docs), langs), bool)
    chosen[np.arange(len(docs)), best] = True
    pi, score = chosen.astype(float), single.max(axis=1)
    # No set can explain a word better than its best language does.
    active = np.flatnonzero(base - score > penalty)

    def run_em(d: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.zeros(len(docs), bool)
        mask[d] = True
        w = mask[which]
        at = (np.cumsum(mask) - 1)[which[w]]
        cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        x, n = lik[w], count[w].astype(float)
        p = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            joint = x * p[at]
            mass = np.maximum(joint.sum(axis=1), 1e-300)
            p = np.add.reduceat(joint * (n / mass)[:, None], cut) / total[d][:, None]
        mass = np.maximum((x * p[at]).sum(axis=1), 1e-300)
        return p, np.add.reduceat(np.log(mass) * n, cut) + base[d]

    size = 1
    while len(active) and size < langs:
        # The candidate: the language that explains most of what the chosen set explains worst.
        mask = np.zeros(len(docs), bool)
        mask[active] = True
        w = mask[which]
        at = (np.cumsum(mask) - 1)[which[w]]
        cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        now = np.maximum((lik[w] * pi[active][at]).sum(axis=1), 1e-300)
        gain = np.add.reduceat(np.log1p(lik[w] / now[:, None] * 0.1) * weight[w], cut)
        gain[chosen[active]] = -np.inf
        add = gain.argmax(axis=1)
        wider = chosen[active].copy()
        wider[np.arange(len(active)), add] = True
        p, ll = run_em(active, wider.astype(float))
        better = ll - score[active] > penalty[active]
        done = active[better]
        pi[done], score[done], chosen[done] = p[better], ll[better], wider[better]
        size += 1
        active = done[base[done] - score[done] > penalty[done]]
    share[docs] = pi
    loglik_of = np.zeros(rows)
    loglik_of[docs] = score
    return share, loglik_of


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, mixture and the columns in `keep`): the language with the largest proportion, that
    proportion, and the set's proportions as lang:share.

    `und` and score 0 where the text is null or has no letter. A text of letters without a usable word (all words hold
    digits, say) is judged by the model's first language alone with score 0. Ties go to the first language in order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    extra = [f for f in docs.select(*keep).schema] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = shared.value
        for batch in batches:
            column = batch.column("text")
            names, scores, sets = [], [], []
            _, offsets = string_bytes(column)
            for a, b in doc_chunks(offsets, 1 << 21):
                part = column.slice(a, b - a)
                lettered = pc.fill_null(pc.match_substring_regex(part, r"\pL"), False).to_numpy(zero_copy_only=False)
                row, word, count, dictionary = word_counts(part)
                table_ = known.words(dictionary) if len(row) else np.zeros((0, len(known.languages)))
                share, _ = mixtures(row, count, table_[word] if len(row) else table_, b - a)
                for ok, p in zip(lettered, share):
                    if not ok or not len(p):
                        names.append("und"), scores.append(0.0), sets.append("")
                        continue
                    k = int(p.argmax())
                    names.append(known.languages[k])
                    scores.append(float(min(1.0, p[k])))
                    sets.append(",".join(f"{lang}:{x:.3f}" for lang, x in zip(known.languages, p) if x >= 0.0005))
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(f"keep{i}") for i in range(len(extra))], ["doc_id", "lang_pred", "score", "mixture", *[f"keep{i}" for i in range(len(extra))]])

    ask = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])
    ddl = f"doc_id {ask.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, mixture string" + "".join(f", keep{i} {f.dataType.simpleString()}" for i, f in enumerate(extra))
    out = in_arrow(ask, run, ddl)
    return out.withColumnsRenamed({f"keep{i}": c for i, c in enumerate(keep)})


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from fitting: crc32 of its id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fit to the rows that aren't held out and predict all rows. An empty table, or one without labels, gives `und`."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col, keep)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document's whole text, learnt from the rows that aren't held out."""
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "mixture")


QUERIES = {"op2_language_mixture": op2_language_mixture}
ORACLES: dict[str, str] = {}
