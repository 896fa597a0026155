"""First match in an ordered list of tests of a ledger's texts: in one expression for short lists, by an index for long ones."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many tests are tried on the rows themselves, which reads them once; more are looked up for each distinct
#: combination of texts, which reads the rows twice.
CHAIN = 50
#: Letters of a gram under which a pattern is indexed.
GRAM = 3

#: (index, [(which of the texts, how, value)]): it holds if one of its conditions does. How is `regex`, found anywhere, or `equal`, case apart.
Test = tuple[int, list[tuple[int, str, str]]]


def java_pattern(pattern: str) -> str:
    """Named groups and classes as Java and Python both read them: (?P<n>) becomes (?<n>), classes are Unicode."""
    return "(?U)" + pattern.replace("(?P<", "(?<")


def _folded(c: Column) -> Column:
    """One letter for all that match each other with case apart."""
    # The letters beyond ASCII that match one of it; upper case between would be optimized away.
    return F.lower(F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, "İıſK", "iisk")))


def _holds(text: Column, how: str, value: str) -> Column:
    return text.rlike(java_pattern(value)) if how == "regex" else F.upper(text) == value.upper()


def holds(test: Test, texts: dict[str, Column], folded: Sequence[Column] | None = None) -> Column:
    """Whether a test holds for a row; false where its texts are null. With the texts also `folded`, a pattern is only tried where one of
    the literals is that it can't do without, which is found many times as fast."""
    values = list(texts.values())

    def one(k: int, how: str, value: str) -> Column:
        found = literals(value) if how == "regex" and folded is not None else None
        full = _holds(values[k], how, value)
        return full if not found else reduce(lambda a, b: a | b, [F.contains(folded[k], F.lit(x)) for x in found]) & full

    return F.coalesce(reduce(lambda a, b: a | b, [one(*condition) for condition in test[1]]), F.lit(False))


def with_values(rows: DataFrame, index: str, values: dict[int, tuple], names: Sequence[str], chain: int = CHAIN) -> DataFrame:
    """rows with the texts that belong to an index, one column for each name; null where there is none. Long lists are joined."""
    if not values:
        return rows.withColumns({n: F.lit(None).cast("string") for n in names})
    if len(values) <= chain:
        pairs = {n: F.create_map(*[F.lit(x) for i, v in values.items() for x in (i, v[k])]) for k, n in enumerate(names)}
        return rows.withColumns({n: F.try_element_at(m, F.col(index)).cast("string") for n, m in pairs.items()})
    table = rows.sparkSession.createDataFrame([(i, *v) for i, v in values.items()], ", ".join([f"{index} int", *[f"{n} string" for n in names]]))
    return rows.join(F.broadcast(table), index, "left")  # a list curated by hand


def literals(pattern: str) -> list[str] | None:
    """Texts of which each match of the pattern has at least one, letters in lower case; None if the pattern doesn't tell. The texts
    have GRAM letters or more and are of ASCII, which lower case folds as matching does."""
    if re.search(r"\[[^\]]*\[|&&", pattern):  # classes that Java reads otherwise
        return None
    try:
        found = _required(parser.parse(pattern))
    except Exception:  # noqa: BLE001  forms that only Java reads
        return None
    return sorted(set(found)) if found and min(map(len, found)) >= GRAM else None


def _required(tree) -> list[str] | None:
    """The best of what the pieces of a sequence ask for: runs of letters, or what each branch of an alternative asks for."""
    choices, run = [], ""
    for op, value in tree:
        if op is ops.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        choices, run = choices + [[run]], ""
        if op is ops.BRANCH:
            parts = [_required(part) for part in value[1]]
            choices.append([x for part in parts for x in part] if all(parts) else None)
        elif op is ops.SUBPATTERN:
            choices.append(_required(value[-1]))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] >= 1:
            choices.append(_required(value[-1]))
        elif op is ops.ATOMIC_GROUP:
            choices.append(_required(value))
    choices.append([run])
    usable = [c for c in choices if c and all(c)]
    return max(usable, key=lambda c: min(map(len, c)), default=None)


def first_match(rows: DataFrame, keys: list[str], tests: Sequence[tuple[int, Column]], name: str) -> DataFrame:
    """rows with `name`, the index of the first condition that holds for their keys; null if none does.

    Few conditions run on each row. Many run once for each distinct combination of the keys, which are then joined back (null-safe)."""
    first = F.coalesce(*[F.when(t, F.lit(i)) for i, t in tests]) if tests else F.lit(None).cast("int")
    if len(tests) <= CHAIN:
        return rows.withColumn(name, first)
    found = rows.select(*keys).distinct().withColumn(name, first)
    found = found.where(F.col(name).isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in keys], name)
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(found[f"_{k}"]) for k in keys])
    return rows.join(found, same, "left").drop(*[f"_{k}" for k in keys])


def first_text_match(rows: DataFrame, texts: dict[str, Column], tests: Sequence[Test], name: str, chain: int = CHAIN) -> DataFrame:
    """first_match for tests of texts. `texts` are the columns that tests are of, each with the text to test (of that column alone).

    Few tests run on each row, in order. With more, each is indexed: an equality by its value, a pattern by the rarest gram of
    each literal that it can't do without. The distinct combinations of the columns fetch candidates by their own grams and values,
    only those are tried, and the results are joined back (null-safe). Patterns without a literal are tried on all."""
    spark, values = rows.sparkSession, list(texts.values())
    if len(tests) <= chain:
        folds = [f"_folded{i}" for i in range(len(values))]
        held = rows.withColumns({c: _folded(v) for c, v in zip(folds, values)})
        return first_match(held, list(texts), [(i, holds((i, conditions), texts, [F.col(c) for c in folds])) for i, conditions in tests], name).drop(*folds)
    indexed, open_ = _index(tests)
    keys = {c: f"_{i}" for i, c in enumerate(texts)}
    each = rows.select(*texts).distinct().select(*[F.col(f"`{c}`").alias(k) for c, k in keys.items()], *[t.alias(f"_t{i}") for i, t in enumerate(values)])

    def tokens_of(i: int) -> Column:
        text = F.coalesce(f"_t{i}", F.lit(""))
        own = F.array_distinct(F.concat(F.array(F.concat(F.lit("="), F.upper(text))), _grams(_folded(text))))
        return F.transform(own, lambda g: F.concat(F.lit(f"{i}"), g))

    tokens = F.concat(*[tokens_of(i) for i in range(len(values))])
    table = spark.createDataFrame(indexed, "token string, index int, slot int, how string, value string")
    asked = each.withColumn("token", F.explode(tokens)).join(F.broadcast(table), "token")  # a list curated by hand, as the tests are
    text = F.element_at(F.array(*[F.col(f"_t{i}") for i in range(len(values))]), F.col("slot") + 1)
    hit = F.when(F.col("how") == "equal", F.upper(text) == F.upper("value")).otherwise(F.rlike(text, F.concat(F.lit("(?U)"), "value")))
    hits = asked.where(hit).select(*keys.values(), "index")
    if open_:
        always = F.coalesce(*[F.when(reduce(lambda a, b: a | b, [_holds(F.col(f"_t{k}"), "regex", v) for k, v in conditions]), F.lit(i)) for i, conditions in open_])
        hits = hits.unionByName(each.withColumn("index", always).where("index is not null").select(*keys.values(), "index"))
    found = hits.groupBy(*keys.values()).agg(F.min("index").alias(name))
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(found[k]) for c, k in keys.items()])
    return rows.join(found, same, "left").drop(*keys.values())


def _grams(text: Column) -> Column:
    return F.when(F.length(text) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substr(text, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def _index(tests: Sequence[Test]) -> tuple[list[tuple], list[tuple[int, list[tuple[int, str]]]]]:
    """((token, index, slot, how, value) rows, tests of patterns without literals)."""
    seen: dict[str, int] = {}
    wanted = {}
    for _, conditions in tests:
        for _, how, value in conditions:
            if how == "regex" and value not in wanted:
                wanted[value] = literals(value)
                for literal in wanted[value] or []:
                    for at in range(len(literal) - GRAM + 1):
                        seen[literal[at : at + GRAM]] = seen.get(literal[at : at + GRAM], 0) + 1
    rows, open_ = [], []
    for i, conditions in tests:
        bare = []
        for k, how, value in conditions:
            if how == "equal":
                rows.append((f"{k}={value.upper()}", i, k, how, value))
            elif wanted[value] is None:
                bare.append((k, value))
            else:
                grams = {min((x[at : at + GRAM] for at in range(len(x) - GRAM + 1)), key=lambda g: (seen[g], g)) for x in wanted[value]}
                rows += [(f"{k}{g}", i, k, how, value.replace("(?P<", "(?<")) for g in sorted(grams)]
        if bare:
            open_.append((i, bare))
    return rows, open_


def valid_patterns(dictionary: DataFrame, column: str) -> list:
    """The dictionary's rows whose pattern compiles; dictionaries are lists curated by hand and small."""
    rows = dictionary.collect()
    compiler = dictionary.sparkSession._jvm.java.util.regex.Pattern
    out = []
    for r in rows:
        if r[column] is not None:
            try:
                compiler.compile(java_pattern(r[column]))
            except Exception:  # noqa: BLE001  the pattern is left out, as a rule that can't match
                continue
        out.append(r)
    return out
