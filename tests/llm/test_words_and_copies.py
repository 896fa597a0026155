"""Spelling variants, exact copies and the divergence of sources on small fixtures, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cardloom.llm import divergence, exact_dedup, spelling

CLASHING = "doc_id bigint, text string, lang string, source string, name string, h bigint, word string, owner int, best int, place int, group string, uid int, term string, pos int, __digest int"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, "z", 5, "t", 6, 7) for r in rows], CLASHING)


def texts(seed, n, words=40):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcÄé×") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    made = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, words))) for _ in range(n)]
    rows = [(i, t, rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s:3", None, ""])) for i, t in enumerate(made)]
    rows += [(n + i, made[i], "en", "s1") for i in range(0, n // 2, 3)]
    odd = [None, "", " \n", "1 2 3", "Ä" * 70_000, "word " * 30_000, "a\x00b é日本"]
    return rows + [(2 * n + i, t, "en", "s2") for i, t in enumerate(odd)] + [rows[1], rows[1], (None, made[2], None, None), (None, made[2], None, None), (None, "alone", "en", "s1"), (3, "other text of id 3", "de", "s1")]


# --- exact copies -----------------------------------------------------------------------------------------------------


def groups_of(rows, normal=lambda t: t):
    of = {}
    for doc, text, *_ in rows:
        of.setdefault(normal(text or ""), []).append(doc)
    low = lambda d: -1 if d is None else d
    out = Counter()
    for text, ids in of.items():
        keep = max(ids, key=low)
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for doc in sorted(ids, key=low, reverse=True):
            out[(doc, keep, len(ids), first, digest)] += 1
            first = False
    return out


@pytest.mark.parametrize("bits, capacity", [(64, 65_536), (64, 4), (5, 2), (0, 10)])
def test_exact_copies_equal_brute_force(spark, bits, capacity):
    """With few bits many texts share a hash: chains and directories of every shape give the same groups."""
    rows = texts(1, 60)
    got = exact_dedup.exact_duplicates(docs(spark, rows), bits=bits, capacity=capacity)
    assert Counter(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == groups_of(rows)


def test_exact_copies_after_normalising_and_of_no_rows(spark):
    rows = [(1, "A b", None, None), (2, "a  B ", None, None), (3, "a b", None, None), (4, None, None, None), (5, " ", None, None)]
    got = exact_dedup.exact_duplicates(docs(spark, rows), normal="space")
    assert {r["doc_id"]: r["keep_id"] for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 5, 5: 5}
    got = exact_dedup.exact_duplicates(docs(spark, rows), normal="lower")
    assert {r["doc_id"]: r["keep_id"] for r in got.collect()} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    rnd = random.Random(3)
    hashes = [rnd.getrandbits(64) - 2**63 for _ in range(400)] + [(7 << 55) + rnd.getrandbits(55) for _ in range(60)]
    for alike in ([], [5 + i for i in range(40)]):  # forty that only the last bits part stay together
        entries, depth = exact_dedup.directory(spark.createDataFrame([(h,) for h in hashes + alike], "h bigint"), 16)
        bucket = {r["entry"]: r["bucket"] for r in entries.collect()}
        assert set(bucket) <= set(range(2**depth)) and all(bucket[b] == b for b in bucket.values())
        held = Counter(bucket[(h % 2**64) >> (64 - depth)] for h in hashes + alike)
        assert sum(n > 16 for n in held.values()) == bool(alike) and len(set(bucket.values())) > 30


def test_dropping_exact_copies(spark):
    rows = texts(2, 30)
    got = exact_dedup.drop_exact_copies(docs(spark, rows))
    assert got.columns == docs(spark, []).columns
    assert Counter((r["doc_id"], r["text"] or "") for r in got.collect()) == Counter({(k[1], t) for k in groups_of(rows) for t in [next((x or "") for _, x, *_ in rows if hashlib.sha256((x or "").encode()).hexdigest() == k[4])]})


# --- spelling variants ------------------------------------------------------------------------------------------------


def spelt(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % spelling.MISSPELT == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            n[word] += len(word) >= 6
    return {w: k for w, k in n.items() if k >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def grouped(n):
    out = {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x.encode()), default=None)
        out[w] = [best if best is not None and n[best] >= 5 * n[w] else None, n[w], len(near)]
    for w, r in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        r += [root, n[r[0]] if r[0] is not None else None]
    return out


def word_list(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 12))) for _ in range(60)] + ["prefixed" + a + b for a in "abcdeé" for b in "abcdeéÿ"]
    n = {}
    for w in base:
        n[w] = rnd.choice([5, 6, 30, 31, 150, 800, 4000])
        for _ in range(4):
            i, c = rnd.randrange(len(w) + 1), rnd.choice("abé")
            n.setdefault(rnd.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]), rnd.choice([5, 6, 6, 25, 160]))
    return {w: k for w, k in n.items() if len(w) >= 6} | {"ab" * 900: 5, "ab" * 900 + "c": 25}


@pytest.mark.parametrize("most_compared", [1 << 20, 60, 0])
def test_spelling_groups_equal_brute_force(spark, most_compared):
    """Hot chunks are halved further: with a low limit all are, down to a single open place."""
    n = word_list(5)
    table = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = {r["word"]: [r["form"], r["n"], r["n_near"], r["root"], r["form_n"]] for r in spelling.spelling_groups(table, most_compared=most_compared).collect()}
    want = grouped(n)
    assert got == want and sum(r[3] != r[0] and r[0] is not None for r in want.values()) > 0


def test_chains_of_forms(spark):
    n = {"a" * (6 + i): 5 * 6**i for i in range(9)}
    got = spelling.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n bigint")).collect()
    assert {r["root"] for r in got} == {"a" * 14}
    assert spelling.spelling_groups(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_words_of_odd_rows(spark):
    rows = texts(7, 80, 300)
    got = {r["word"]: r["n"] for r in spelling.spelt_words(docs(spark, rows)).collect()}
    assert got == spelt(rows) and len(got) > 10
    assert spelling.spelling_variants(docs(spark, [])).count() == 0


def test_crc_of_stretches():
    rnd = random.Random(9)
    data = np.frombuffer(bytes(rnd.randrange(256) for _ in range(5000)), np.uint8)
    starts = np.array([rnd.randrange(4800) for _ in range(200)])
    ends = starts + np.array([rnd.choice([0, 1, 5, 9, 63, 64, 65, 150]) for _ in range(200)])
    seeds = np.array([zlib.crc32(str(i).encode()) for i in range(200)], np.uint32)
    assert spelling.crc_of(data, starts, ends, seeds).tolist() == [zlib.crc32(str(i).encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(starts, ends))]


# --- divergence of sources --------------------------------------------------------------------------------------------


def audited(rows, min_docs, most_terms):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    counts, seen, groups = Counter(), Counter(), {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        found = term.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        counts.update((lang, source, w) for w in found)
        seen.update((lang, w) for w in set(found))
    out = []
    for lang, sources in groups.items():
        kept = [w for (k, w), n in seen.items() if k == lang and n >= min_docs]
        share = lambda of: (lambda total: {w: 1 + 10**9 * (of(w) + 5) // (total + 5 * len(kept)) for w in kept})(sum(map(of, kept)))
        p = {s: share(lambda w, s=s: counts[lang, s, w]) for s in sources}
        q = share(lambda w: sum(counts[lang, s, w] for s in sources))
        for s in sources:
            parts = {"pair": [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources - {s}], "term": [(p[s][w] - q[w], w) for w in kept if counts[lang, s, w] and p[s][w] > q[w]]}
            for part, values in parts.items():
                values.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(values) if part == "pair" or i < most_terms]
    return Counter(out)


@pytest.mark.parametrize("min_docs, most_terms, block, tile", [(3, 50, 16_384, 64), (2, 5, 8, 2), (9, 50, 5, 1), (10_000, 50, 16_384, 64)])
def test_divergence_equals_brute_force(spark, min_docs, most_terms, block, tile):
    """Small blocks and tiles, languages without kept terms, sources that are null, empty or without terms."""
    rows = texts(11, 90) + [(500, "1 2", "xx", "s1"), (501, None, "xx", "s2"), (502, "lone words", "yy", None)]
    got = divergence.divergence(docs(spark, rows), min_docs=min_docs, most_terms=most_terms, block=block, tile=tile)
    assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == audited(rows, min_docs, most_terms)


def test_divergence_of_no_rows(spark):
    assert divergence.divergence(docs(spark, [])).count() == 0


def test_runs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.integers(0, 3, 40) for _ in range(2))
        assert divergence.run_difference(divergence.runs(a), divergence.runs(b), 40) == np.abs(a - b).sum()
