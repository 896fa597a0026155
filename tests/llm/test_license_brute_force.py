"""The licence scan against a plain TF-IDF and a walk up the directories."""

import math
import random
import re
from collections import Counter

import regex

from cardloom.llm import licenses

BODIES = [("L-1", "granted herewith", "Permission is granted herewith to all who read this text to use the thing as they like, without any warranty."), ("L-2", "covered thing", "Each covered thing may be passed on by those who got it, if its sources go with it and this text stays whole.")]


def terms(text):
    return [t for t in (re.sub(r"^[.\-]+|[.\-]+$", "", x) for x in regex.split(r"[^\p{L}\p{N}.\-]+", text.lower())) if t]


def plain_scan(rows, templates, bodies, threshold=0.7):
    key, body_key = re.compile("|".join(re.escape(k.lower()) for _, k, _ in templates), re.I), re.compile("|".join(r"\s+".join(map(re.escape, k.split())) for _, k, _ in bodies), re.I)
    opening = "|".join(sorted({r"\s+".join(re.escape(w) for w in t.split()[:2]) for _, _, t in templates}))
    begin = re.compile(rf"(?<=[.!?;])\s+|\n+|\s+(?=(?i:{opening}))")
    vocabulary = {t for _, _, text in [*templates, *bodies] for t in terms(text)}
    seen = Counter(t for _, _, text in rows for t in set(terms(text or "")) & vocabulary)
    idf = lambda t: math.log((1 + len(rows)) / (1 + seen[t])) + 1 if t in vocabulary else math.log(1 + len(rows)) + 1
    vector = lambda text: {t: n * idf(t) for t, n in Counter(terms(text)).items()}

    def cosine(a, b):
        dot = sum(x * b.get(t, 0) for t, x in a.items())
        return round(min(1.0, dot / math.sqrt(sum(x * x for x in a.values())) / math.sqrt(sum(x * x for x in b.values()))), 9) if dot else 0

    def best(text, known):
        scores = [(name == licenses.GENERIC, -cosine(vector(text), vector(t)), name) for name, _, t in known]
        return min([s for s in scores if -s[1] >= threshold], default=None)

    judged = []
    for doc, path, text in rows:
        by_name = bool(path and re.search(licenses.LICENCE_FILE, path))
        pieces = [(p, best(p.lower(), templates)) for p in begin.split(text) if key.search(p)] if text and key.search(text) else []
        if text and (by_name or body_key.search(text)):
            pieces.append((text, best(text.lower(), bodies)))
        found = [(p, b) for p, b in pieces if b]
        own = min((b for _, b in found), default=None)
        judged.append((doc, path, own, bool(own) and (by_name or sum(len(p) for p, _ in found) / len(text) >= licenses.MOSTLY)))
    folder = lambda path: re.sub("/?[^/]*$", "", path)
    rules = {}
    for _, path, own, is_file in judged:
        if is_file and path is not None:
            rules[folder(path)] = min(rules.get(folder(path), (1, "", "")), (own[1], path, own[2]))
    out = {}
    for doc, path, own, is_file in judged:
        if own:
            out[doc] = (own[2], round(-own[1], 9), "file" if is_file else "header", path)
            continue
        steps = folder(path).split("/") if path is not None else []
        above = [rules["/".join(steps[:n])] for n in range(len(steps), -1, -1) if "/".join(steps[:n]) in rules] if path is not None else []
        out[doc] = (above[0][2], round(-above[0][0], 9), "inherited", above[0][1]) if above else (None, None, "none", None)
    return out


def test_scan_equals_plain_tf_idf(spark):
    rnd = random.Random(12)
    filler = ["the code reads tables", "a licensed driver", "all rights are reserved here", "public places", "nothing else to say", "this library is old", "version 2.0 of it"]
    rows = []
    for i in range(120):
        pieces = [rnd.choice(filler) + rnd.choice([".", ";", "\n", ""]) for _ in range(rnd.randint(0, 4))]
        if rnd.random() < 0.4:
            words = rnd.choice(licenses.TEMPLATES)[2].split()
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = rnd.choice(["some", "License", "2.0", "GPL"])
            pieces.insert(rnd.randint(0, len(pieces)), " ".join(words))
        if rnd.random() < 0.15:
            pieces = [rnd.choice(BODIES)[2], *pieces[:1]]
        path = "/".join([rnd.choice("abc") for _ in range(rnd.randint(0, 3))] + [rnd.choice(["x.py", "y.txt", "LICENSE", "copying.md", "notice"])])
        rows.append((i, rnd.choice([path] * 12 + [None]), rnd.choice([" ".join(pieces)] * 14 + [None])))
    make = lambda table, ddl: spark.createDataFrame(table, ddl)
    known = "license string, key string, text string"
    got = licenses.scan_licenses(make(rows, "id bigint, path string, text string"), make(licenses.TEMPLATES, known), "id", "path", "text", bodies=make(BODIES, known))
    want = plain_scan(rows, licenses.TEMPLATES, BODIES)
    assert {r["id"]: (r["license"], None if r["score"] is None else round(r["score"], 9), r["origin"], r["licence_path"]) for r in got.collect()} == want
    assert {o for _, _, o, _ in want.values()} == {"file", "header", "inherited", "none"} and len({n for n, *_ in want.values()}) > 8
