"""Ordered first-match rules with precedence and human locks; predicates and counts on the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, slugify, strip
from .matching import Test, first_text_match, holds, valid_patterns, with_values

FINAL = ("manual", "rule", "merchant")


def _texts() -> dict[str, Column]:
    """What rules are tested on; empty texts match nothing."""
    return {c: F.when(F.col(c) != "", F.col(c)) for c in ("canonical_merchant", "normalized_merchant", "raw_description")}


def _test(rule) -> Test:
    """A rule (kind canonical | exact | regex, pattern) as a test of these texts. The kinds exclude one another."""
    kinds = {"canonical": [(0, "equal")], "exact": [(1, "equal")]}
    return rule["rule_idx"], [(k, how, rule["pattern"]) for k, how in kinds.get(rule["kind"], [(0, "regex"), (1, "regex"), (2, "regex")])]


def _rules(rules: DataFrame) -> list:
    fixed = rules.where("kind <> 'regex' and pattern is not null").collect()
    return sorted(fixed + valid_patterns(rules.where("kind = 'regex' and pattern is not null"), "pattern"), key=lambda r: r["rule_idx"])


def classify(ledger: DataFrame, rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """The first rule (rule_idx, kind, pattern, category, subcategory) that holds sets category, subcategory and
    classified_by `rule`; else the merchant's default (`merchant`); else all three are null. Earlier values go."""
    rows = _rules(rules)
    found = first_text_match(ledger, _texts(), [_test(r) for r in rows], "_rule")
    own = defaults.select(F.col("canonical").alias("_canonical"), F.col("category").alias("_category"), F.coalesce("subcategory", F.lit("")).alias("_subcategory"))
    found = with_values(found, "_rule", {r["rule_idx"]: (r["category"] or "", r["subcategory"] or "") for r in rows}, ("_c", "_s"))
    found = found.join(own, found["canonical_merchant"] == own["_canonical"], "left")
    ruled, known = F.col("_rule").isNotNull(), F.col("_category").isNotNull()
    return found.withColumns({
        "category": F.when(ruled, F.col("_c")).when(known, F.col("_category")),
        "subcategory": F.when(ruled, F.col("_s")).when(known, F.col("_subcategory")),
        "classified_by": F.when(ruled, "rule").when(known, "merchant"),
    }).select(*ledger.columns)


def classify_ledger(ledger: DataFrame, aliases: DataFrame, rules: DataFrame) -> DataFrame:
    """Canonicalize and classify all rows but those classified by hand, which keep their values; one row for each id."""
    return classify_rows(ledger, aliases, rules).dropDuplicates(["txn_id"])


def classify_rows(ledger: DataFrame, aliases: DataFrame, rules: DataFrame) -> DataFrame:
    """classify_ledger for rows whose ids are known to differ, as `normalize` gives them: nothing is shuffled."""
    from .merchants import canonicalize, merchant_defaults

    named = canonicalize(ledger, aliases)
    kept = {c: F.col(f"_was.{c}") for c in ("category", "subcategory", "classified_by")}
    held = named.withColumn("_was", F.struct(*kept))
    out = classify(held, rules, F.broadcast(merchant_defaults(aliases)))
    manual = F.coalesce(F.col("_was.classified_by") == "manual", F.lit(False))
    return out.withColumns({c: F.when(manual, was).otherwise(F.col(c)) for c, was in kept.items()}).drop("_was")


def classification_counts(ledger: DataFrame) -> DataFrame:
    by = F.coalesce("classified_by", F.lit(""))
    names = {"rule": "rule", "merchant": "merchant", "ai": "ai", "manual": "manual", "open": ""}
    return ledger.agg(*[F.count_if(by == v).alias(k) for k, v in names.items()], F.count("*").alias("total"))


def _open_category() -> Column:
    return F.coalesce("category", F.lit("")).isin("", "Uncategorized")


def needs_review() -> Column:
    """Not settled by rule, hand or merchant, and either suggested or without a category."""
    by = F.coalesce("classified_by", F.lit(""))
    return ~by.isin(*FINAL) & ((by == "ai") | _open_category())


def is_open() -> Column:
    """Not settled by rule, hand or merchant, or without a category."""
    return ~F.coalesce("classified_by", F.lit("")).isin(*FINAL) | _open_category()


def needs_suggestion() -> Column:
    """Not settled by rule, hand or merchant, and the category is blank or Uncategorized."""
    return ~F.coalesce("classified_by", F.lit("")).isin(*FINAL) & strip(F.coalesce("category", F.lit(""))).isin("", "Uncategorized")


def review_queue(ledger: DataFrame, limit: int = 100) -> DataFrame:
    """The largest rows to review, with how many there are in all."""
    rows = ledger.where(needs_review())
    top = rows.orderBy(F.desc("amount"), "txn_id").limit(limit)
    return top.crossJoin(F.broadcast(rows.agg(F.count("*").alias("queue_total"))))


def apply_rule_to_open(ledger: DataFrame, rule: dict) -> DataFrame:
    """One new rule (kind, pattern, category, subcategory) on the rows to review; `changed` marks what it set."""
    hit = needs_review() & holds(_test({"rule_idx": 0} | dict(rule)), _texts())
    return ledger.withColumn("changed", hit).withColumns({
        "category": F.when(F.col("changed"), rule["category"]).otherwise(F.col("category")),
        "subcategory": F.when(F.col("changed"), rule.get("subcategory") or "").otherwise(F.col("subcategory")),
        "classified_by": F.when(F.col("changed"), "rule").otherwise(F.col("classified_by")),
        "proposed_category": F.when(~F.col("changed"), F.col("proposed_category")),
        "proposed_subcategory": F.when(~F.col("changed"), F.col("proposed_subcategory")),
    })


def apply_review_decisions(ledger: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions (txn_id, category, subcategory, tags or null) set by hand; and those whose txn_id is unknown."""
    d = decisions.select("txn_id", *[F.col(c).alias(f"_{c}") for c in ("category", "subcategory", "tags")], F.lit(True).alias("_hit")).dropDuplicates(["txn_id"])
    on = F.coalesce("_hit", F.lit(False))
    out = ledger.join(d, "txn_id", "left").withColumns({
        "category": F.when(on, F.col("_category")).otherwise(F.col("category")),
        "subcategory": F.when(on, F.coalesce("_subcategory", F.lit(""))).otherwise(F.col("subcategory")),
        "tags": F.coalesce(F.when(on, F.col("_tags")), F.col("tags")),
        "classified_by": F.when(on, "manual").otherwise(F.col("classified_by")),
        "proposed_category": F.when(~on, F.col("proposed_category")),
        "proposed_subcategory": F.when(~on, F.col("proposed_subcategory")),
    })
    return out.select(*ledger.columns), decisions.join(ledger.select("txn_id"), "txn_id", "left_anti")


def split_tags(text: Column | str) -> Column:
    """Tags written as text: split at , and |, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), r"[,|]"), lambda t: strip(t)), lambda t: t != "")


def clean_tags(tags: Column | str) -> Column:
    """An array of tags: trimmed, without blanks and nan, each once in order; null is empty."""
    trimmed = F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), lambda t: strip(F.coalesce(t, F.lit(""))))
    return F.array_distinct(F.filter(trimmed, lambda t: ~F.lower(t).isin("", "nan")))


def tag_slug(text: Column | str) -> Column:
    return slugify(text, "tag")


def tags_in_use(ledger: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, in_use) of each tag of the vocabulary."""
    used = ledger.select(F.explode(clean_tags("tags")).alias("id")).distinct().withColumn("in_use", F.lit(True))
    return tags.select("id").join(used, "id", "left").select("id", F.coalesce("in_use", F.lit(False)).alias("in_use"))
