"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

The field is trained by maximum likelihood on a small labelled table: rows written out below and a bounded sample of the
documents, labelled by the fixed patterns. A word without a digit or @ is always outside, so the best path of a text is
the best paths of the stretches between such words, one after another; only these are decoded, by Viterbi in numpy
batches, equal stretches of shapes once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import in_arrow, table

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Rows of documents the field is trained on at most, longest stretch in training, steps, how often a labelled row counts, and
#: the log-odds an added span needs (the last two chosen on rows that are neither in LABELLED nor in the tests).
FIT_ROWS, LONGEST, STEPS, WEIGHT, MARGIN = 800, 24, 200, 10, 1.0
#: Stretches of shapes whose best path a task remembers.
MEMORY = 100_000

_SPACE = r"\x20\x09-\x0D"
_SOME = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: there the same continuation has failed from its first digit.
_IP = re.compile(r"(?<![0-9])([0-9]++)(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGE = ".,;:!?\"'"

#: A small labelled table; spans stand between < and >, with the first letter of their kind (p is for phone).
LABELLED = (
    "call p<(656) 555-6510> today", "ring p<656-555-6510> or p<656.555.6510>", "fax p<+1 (656) 555-6510>.", "tel p<0044 20 7946 0958>",
    "write to e<a.b@mail.example.com>, please", "from i<10.20.30.40> at 12:30", "host i<192.168.0.1:8080> is down",
    "card c<4863 7304 2628 2945> ends", "paid with c<4863-7304-2628-2945>", "c<4863730426282945> was charged",
    "order 12345 of 2021-05-17 for 99.50", "page 12 of 300", "in 1999 and 2004", "version 3.2.1 of 12.5", "room 101 at 10:45", "ratio 3-4 or 5",
    "free p<1-800-555-0100> line", "p<1-866-555-0123>, all week", "p<1.877.555.0145> works", "call p<(480)555-0117> now", "p<(913)555-0140>, or write", "London p<020 7123 4567> desk",
    "Paris p<01 23 45 67 89> office", "p<0161 496 0123> in the north", "dial p<(656) 555-6511>, then p<656-555-6512>", "p<1 (656) 555-6513> or p<1 656 555 6514>", "p<0033 1 23 45 67 89> abroad",
    "home p<656-555-6520> is best", "p<656-555-6521>", "fax p<656.555.6522>, please", "number p<656.555.6523>.", "p<020 7123 4568>; ask", "Lyon p<04 12 34 56 79> office", "p<0044 20 7946 0959>, London",
    "card c<4863.7304.2628.2946> dotted", "c<5105.1051.0510.5101>, expired", "c<4863/7304/2628/2947> slashed", "old c<3714 496353 98432> blue", "c<5105-1051-0510-5102> gone", "paid c<6011 0009 9013 9425> late",
    "e<first.last@dept.example.edu> replied", "i<10.1.2.3> and i<10.1.2.4> talk", "count 1 2 3 4 then stop", "rows 5 6 7 8 9 10 11", "scores 21 19 25 30 and 44", "years 1990 1991 1992 1993", "codes 12-34-56 or 78-90",
    "ISBN 978-0-306-40615-7 again", "range 1000-2000 of 5000", "10 20 30 40 50 60", "part 555-0199 is no phone", "item 12.34.56 of list", "dated 2020.05.17 or 17/05/2020", "serial 2021-0004-11",
    "id 000123456789 and 77", "CC BY-NC 4.0.", "version 3. Then 17", "costs 1,299.00 or 12%", "a 1 b 2 c 3", "chapter 4.2.1.7b", "sum 3.14159 x2",
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start: leftmost non-overlapping matches of each kind."""
    if not _SOME.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := g.lstrip(".").lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# --- shapes and stretches -------------------------------------------------------------------------------------------


def shape(word: str) -> str:
    """Runs of letters as x, of digits as d with their number, other characters as they are; long words by their ends."""
    word = word if len(word) <= 64 else word[:32] + word[-32:]
    return re.sub(r"d+", lambda m: f"d{min(len(m[0]), 20)}", re.sub(r"[^\W\d_]+", "x", re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]", "x", word))).replace("xd", "x\0d")).replace("\0", "")


def _facts(word: str) -> str:
    """The shape of a word without marks at its ends, and what its digits add up to."""
    core = word.strip(_EDGE)
    digits = re.sub(r"[^0-9]", "", core[:64])
    parts = core.split(".")
    address = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)
    return f"{shape(core)}|{min(len(digits), 20)}|{int(13 <= len(digits) <= 19 and luhn(digits))}{int(address)}{int('@' in core)}{int(core.startswith('+'))}"


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Spans of words with a digit or @ that follow one another."""
    run: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(text):
        if run and text[run[-1][1] : m.start()].strip(" \t\n\r\x0b\x0c"):
            yield run
            run = []
        run.append(m.span())
    if run:
        yield run


def features(facts: tuple[str, ...]) -> list[list[str]]:
    """Names of the features of each word of a stretch."""
    out = []
    for i, f in enumerate(facts):
        form, count, flags = f.rsplit("|", 2)
        before, after = (facts[j] if 0 <= j < len(facts) else "none|none|" for j in (i - 1, i + 1))
        b, a = before.rsplit("|", 2)[0], after.rsplit("|", 2)[0]
        plain = re.sub(r"d\d+", "d", form)
        out.append([f"s={form}", f"p={plain}", f"n={count}", f"f={flags}", f"b={b}", f"a={a}", f"bp={re.sub(r'd[0-9]+', 'd', b)}|{plain}", f"ap={plain}|{re.sub(r'd[0-9]+', 'd', a)}"])
    return out


def _tags(run: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    tags = [0] * len(run)
    for kind, start, end in sorted(spans, key=lambda s: s[2] - s[1]):  # of overlapping ones the longest
        k, first = 1 + 2 * KINDS.index(kind), True
        for i, (a, b) in enumerate(run):
            if a < end and b > start:
                tags[i] = k if first else k + 1
                first = False
    return tags


# --- the field ------------------------------------------------------------------------------------------------------

_ALLOWED = np.ones((len(TAGS), len(TAGS)), bool)
for _to in range(2, len(TAGS), 2):  # an I follows its own B or I
    _ALLOWED[:, _to] = False
    _ALLOWED[[_to - 1, _to], _to] = True
_STARTS = np.array([not t.startswith("I") for t in TAGS])


class Field:
    """Weights by feature and tag, and of tag after tag."""

    def __init__(self, chains: list[tuple[tuple[str, ...], list[int]]]):
        self.names: dict[str, int] = {}
        rows = []
        for facts, _ in chains:
            rows.append([[self.names.setdefault(n, len(self.names)) for n in word] for word in features(facts)])
        self.weights = np.zeros((len(self.names) + 1, len(TAGS)))  # the last is for features never seen
        self.moves = np.zeros((len(TAGS), len(TAGS)))
        if chains:
            self._train(rows, [tags for _, tags in chains])

    def _train(self, rows: list, tags: list) -> None:
        n, width, per = len(rows), max(map(len, rows)), len(rows[0][0])
        ids, gold, mask = np.full((n, width, per), len(self.names)), np.zeros((n, width), int), np.zeros((n, width), bool)
        for i, (r, t) in enumerate(zip(rows, tags)):
            ids[i, : len(r)], gold[i, : len(t)], mask[i, : len(r)] = r, t, True
        moments = [np.zeros_like(w) for w in (self.weights, self.moves) for _ in "12"]
        for step in range(1, STEPS + 1):
            g_w, g_m = self._gradient(ids, gold, mask)
            for w, g, m, v in ((self.weights, g_w, *moments[:2]), (self.moves, g_m, *moments[2:])):
                g = g / n + 1e-4 * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.weights[-1] = 0

    def _scores(self, ids: np.ndarray) -> np.ndarray:
        out = self.weights[ids].sum(axis=2)
        out[:, 0] = np.where(_STARTS, out[:, 0], -1e9)
        return out

    def _gradient(self, ids: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected minus observed counts, by the forward-backward recursion over padded chains."""
        n, width, _ = ids.shape
        emit, move = self._scores(ids), np.where(_ALLOWED, self.moves, -1e9)
        ahead, back = np.zeros((width, n, len(TAGS))), np.zeros((width, n, len(TAGS)))

        def add(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

        ahead[0] = emit[:, 0]
        for t in range(1, width):
            ahead[t] = np.where(mask[:, t, None], add(ahead[t - 1][:, :, None] + move, 1) + emit[:, t], ahead[t - 1])
        total = add(ahead[-1], 1)
        for t in range(width - 2, -1, -1):
            back[t] = np.where(mask[:, t + 1, None], add(move + (emit[:, t + 1] + back[t + 1])[:, None, :], 2), back[t + 1])
        g_w, g_m = np.zeros_like(self.weights), np.zeros_like(self.moves)
        for t in range(width):
            p = np.exp(ahead[t] + back[t] - total[:, None])
            p[np.arange(n), gold[:, t]] -= 1
            p *= mask[:, t, None]
            for f in range(ids.shape[2]):
                np.add.at(g_w, ids[:, t, f], p)
            if t:
                both = np.exp(ahead[t - 1][:, :, None] + move + (emit[:, t] + back[t])[:, None, :] - total[:, None, None]) * mask[:, t, None, None]
                g_m += both.sum(axis=0)
                on = mask[:, t]
                np.add.at(g_m, (gold[on, t - 1], gold[on, t]), -1)
        return g_w, np.where(_ALLOWED, g_m, 0)

    def decode(self, chains: list[tuple[str, ...]]) -> list[list[tuple[int, int, int, float]]]:
        """For each stretch the spans (kind, first word, last word, log-odds against none) of its best path."""
        out: list = [None] * len(chains)
        by_length: dict[int, list[int]] = {}
        for i, c in enumerate(chains):
            by_length.setdefault(len(c), []).append(i)
        move = np.where(_ALLOWED, self.moves, -1e9)
        for width, members in by_length.items():
            step = max(1, 4096 // width)
            for s in range(0, len(members), step):
                part = members[s : s + step]
                ids = np.array([[[self.names.get(f, len(self.names)) for f in word] for word in features(chains[i])] for i in part])
                emit = self._scores(ids)
                score, came = emit[:, 0], []
                for t in range(1, width):
                    paths = score[:, :, None] + move
                    came.append(paths.argmax(axis=1))
                    score = paths.max(axis=1) + emit[:, t]
                path = np.zeros((len(part), width), int)
                path[:, -1] = score.argmax(axis=1)
                for t in range(width - 2, -1, -1):
                    path[:, t] = came[t][np.arange(len(part)), path[:, t + 1]]
                for i, e, tags in zip(part, emit, path):
                    out[i] = self._spans(e, tags)
        return out

    def _spans(self, emit: np.ndarray, tags: np.ndarray) -> list[tuple[int, int, int, float]]:
        spans, t = [], 0
        while t < len(tags):
            if tags[t] == 0:
                t += 1
                continue
            end = t + 1
            while end < len(tags) and tags[end] == tags[t] + 1 and tags[end] % 2 == 0:
                end += 1
            inside, around = tags[t:end], [*tags[max(t - 1, 0) : t], *tags[t:end], *tags[end : end + 1]]
            none = [*tags[max(t - 1, 0) : t], *[0] * (end - t), *tags[end : end + 1]]
            odds = (emit[np.arange(t, end), inside] - emit[np.arange(t, end), 0]).sum()
            odds += sum(self.moves[a, b] for a, b in zip(around, around[1:])) - sum(self.moves[a, b] for a, b in zip(none, none[1:]))
            spans.append((int(tags[t] - 1) // 2, t, end - 1, float(odds)))
            t = end
        return spans


def _marked(row: str) -> tuple[str, list[tuple[str, int, int]]]:
    text, spans = "", []
    for piece in re.split(r"([eicp]<[^>]*>)", row):
        if re.fullmatch(r"[eicp]<[^>]*>", piece):
            spans.append(({k[0]: k for k in KINDS}[piece[0]], len(text), len(text) + len(piece) - 3))
            piece = piece[2:-1]
        text += piece
    return text, spans


def train(docs: DataFrame, text_col: str = "text", rows: int = FIT_ROWS) -> Field:
    """Train on LABELLED and on at most `rows` documents with a digit or @, drawn by a hash of the text."""
    some = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    key = F.xxhash64(F.lit(23), "text")
    # The stretches and labels are made on the executors; of the hashes' order only the first rows travel.
    ddl = "h long, facts array<string>, tags array<int>"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"h": [], "facts": [], "tags": []}
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(text)
                for run in stretches(text):
                    for i in range(0, len(run), LONGEST):
                        part = run[i : i + LONGEST]
                        out["h"].append(h)
                        out["facts"].append([_facts(text[a:b]) for a, b in part])
                        out["tags"].append(_tags(part, spans))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema({"h": pa.int64(), "facts": pa.list_(pa.string()), "tags": pa.list_(pa.int32())}))

    count = some.count()
    drawn = some.select(key.alias("h"), "text").where(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(1, count))) + 1)
    found = in_arrow(drawn, label, ddl).orderBy("h", F.col("facts").cast("string"), F.col("tags").cast("string")).limit(10 * rows).collect()
    own = []
    for row in LABELLED:
        text, spans = _marked(row)
        own += [(tuple(_facts(text[a:b]) for a, b in run), _tags(run, spans)) for run in stretches(text)]
    # The patterns' silence on a stretch that the table marks is no label: finding those is what the field is for.
    marked = {facts for facts, tags in own if any(tags)}
    chains = [(tuple(r["facts"]), list(r["tags"])) for r in found]
    return Field([c for c in chains if any(c[1]) or c[0] not in marked] + own * WEIGHT)


def find_spans(texts: list[str | None], field: Field, known: dict) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base, asked, fresh = [], [], {}
    for text in texts:
        text = text or ""
        spans = base_spans(text)
        runs = []
        if _SOME.search(text):
            for run in stretches(text):
                facts = tuple(_facts(text[a:b]) for a, b in run)
                if facts not in known:
                    fresh[facts] = None
                runs.append((run, facts))
        base.append(spans)
        asked.append(runs)
    answers = dict(zip(fresh, field.decode(list(fresh))))
    out = []
    for text, spans, runs in zip(texts, base, asked):
        taken = sorted((a, b) for _, a, b in spans)
        added = []
        for run, facts in runs:
            for kind, first, last, odds in answers[facts] if facts in answers else known[facts]:
                a, b = run[first][0], run[last][1]
                piece = text[a:b]
                a += len(piece) - len(piece.lstrip(_EDGE))
                b -= len(piece) - len(piece.rstrip(_EDGE))
                if odds >= MARGIN and a < b and not any(x < b and y > a for x, y in taken):
                    added.append((KINDS[kind], a, b))
        out.append((spans, sorted(spans + added, key=lambda s: (KINDS.index(s[0]), s[1]))))
    if len(known) + len(answers) > MEMORY:
        known.clear()
    known.update(answers)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, text) for each row: numbers of the patterns' spans, a
    digest of them, all spans, and the text with each span replaced by <KIND>.

    A null text counts as empty (its redacted text is null); rows repeat as they come; other columns are left out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for doc, text, (base, spans) in zip(batch.column(0).to_pylist(), texts, find_spans(texts, shared.value, known)):
                row = {"doc_id": doc, **{f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}}
                row |= {"base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(spans), "text": _redacted(text, spans)}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ask = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("text", pa.string())]
    schema = pa.schema(names)
    return in_arrow(ask, run, "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, text string")


def _redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Overlapping spans become one mark, named by the one that begins first."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """`docs` with the personal data in its texts replaced; all columns and rows stay."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = batch.column(place).to_pylist()
            new = [_redacted(t, spans) for t, (_, spans) in zip(texts, find_spans(texts, shared.value, known))]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    return in_arrow(docs, run, docs.schema)


def op10_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = table(spark, sf_dir, "documents")
    return detect(docs, train(docs)).drop("text")


QUERIES = {"op10_crf_pii": op10_crf_pii}
ORACLES: dict[str, str] = {}
