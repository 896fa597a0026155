"""Long lists of patterns by index: the same first matches as trying them all in order."""

import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import classify, matching, merchants

from test_ledger import ledger


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"(?i)wal[-\s]?mart", ["mart"]), (r"(?i)amazon|\bamzn\b", ["amazon", "amzn"]), (r"(?i)^subscription \d", ["subscription "]), (r"(?:shop|store)+ north", [" north"]), (r"(shop|store) x", ["hop", "tore"]),
        (r"ab", None), (r"(?i)shell|bp", None), (r"[a-z]+", None), (r"(?!foo)", None), (r"foo(?=bar)", ["foo"]), (r"(abc)?d", None), (r"(abc){2}", ["abc"]), (r"café bar", [" bar"]), (r"\Qa.b\E", None), (r"(?P<n>coffee)", ["coffee"]),
        (r"a[b[c]]def", None), (r"(", None), ("", None), (r"x.y", None), (r"a\.b\.c", ["a.b.c"]),
    ],
)
def test_literals(pattern, want):
    assert matching.literals(pattern) == want


def names(seed, n):
    rnd = random.Random(seed)
    pieces = ["SHOP", "CAFÉ", "KIOSK", "İST", "STRASSE", "STRAßE", "ſtore", "bar", "BP", "A.B", "12", "NORTH", "walmart", "Wal-Mart"]
    return [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 3))) for _ in range(n)] + [None, ""]


def test_indexed_aliases_equal_the_chain(spark, monkeypatch):
    rnd = random.Random(4)
    rows = ledger(spark, *[{"amount": 1, "normalized_merchant": a, "raw_description": b} for a, b in zip(names(1, 150), reversed(names(2, 150)))])
    patterns = [r"(?i)kiosk", r"(?i)k\w+sk", r"store", r"(?i)STORE", r"(?i)ist\b", r"(?i)strasse|straße", "^$", "bp", "(?i)BP", r"(?i)wal[-\s]?mart", r"A\.B", r"(?i)café n", "12 NORTH", "(", r"(?i)north (?:shop|bar)", ".*x"]
    entries = [(i, f"N{i}", "regex", p, None, None) for i, p in enumerate(rnd.sample(patterns, len(patterns)))] + [(40 + i, f"E{i}", "exact", v, None, None) for i, v in enumerate(["shop north", "straße", "", "bar"])]
    aliases = spark.createDataFrame(entries, "entry_idx int, canonical string, kind string, pattern string, category string, subcategory string")
    rules = spark.createDataFrame([(i, k, p or "-", f"C{i}", None) for i, (_, _, k, p, *_) in enumerate(reversed(entries))] + [(90, "canonical", "n3", "Z", "z")], "rule_idx int, kind string, pattern string, category string, subcategory string")

    def run():
        named = merchants.canonicalize(rows, aliases)
        return sorted(map(tuple, classify.classify(named, rules, merchants.merchant_defaults(aliases)).select("txn_id", "canonical_merchant", "merchant_source", "category", "subcategory", "classified_by").collect()))

    want = run()
    monkeypatch.setattr(matching.first_text_match, "__defaults__", (0,))
    monkeypatch.setattr(matching.with_values, "__defaults__", (0,))
    assert run() == want and len({r[1] for r in want}) > 8


def test_ten_thousand_aliases(spark):
    """Each descriptor meets its own alias among ten thousand, and no other is tried on it but those that share a rare gram."""
    word = lambda i: "".join("bcdfghjklmnpqrstvwxz"[(i // 20**k) % 20] for k in range(5))
    entries = [(i, f"Brand {i}", "regex", rf"(?i)\b{word(i * 31)}\b|{word(i * 31)[::-1]} (?:inc|ltd)", None, None) for i in range(10_000)]
    aliases = spark.createDataFrame(entries, "entry_idx int, canonical string, kind string, pattern string, category string, subcategory string")
    rows = ledger(spark, *[{"amount": 1, "normalized_merchant": f"THE {word(i * 31).upper()} STORE", "raw_description": f"THE {word(i * 31)}"} for i in range(0, 10_000, 250)], {"amount": 1, "normalized_merchant": "NOTHING", "raw_description": ""})
    got = {r["normalized_merchant"]: r["canonical_merchant"] for r in merchants.canonicalize(rows, aliases).collect()}
    assert got == {f"THE {word(i * 31).upper()} STORE": f"Brand {i}" for i in range(0, 10_000, 250)} | {"NOTHING": None}
