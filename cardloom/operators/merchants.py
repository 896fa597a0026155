"""Canonical merchants: an ordered alias dictionary, default categories, usage and manual stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import first_text_match, valid_patterns, with_values


def canonicalize(ledger: DataFrame, aliases: DataFrame) -> DataFrame:
    """Set canonical_merchant and merchant_source. aliases is (entry_idx, canonical, kind exact|regex, pattern, ...).

    Rows named by hand stay. Else the first entry with an alias equal to the normalized name (case apart), or found in
    the normalized or raw text, names the row (`alias`); without one the name is null (`none`). An alias whose pattern
    doesn't compile contributes nothing."""
    entries = sorted(valid_patterns(aliases.where("kind = 'regex'").select("entry_idx", "canonical", "kind", "pattern"), "pattern") + aliases.where("kind = 'exact'").select("entry_idx", "canonical", "kind", "pattern").collect(), key=lambda r: r["entry_idx"])
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("normalized_merchant", "raw_description")}
    tests = [(r["entry_idx"], [(0, "equal", r["pattern"])] if r["kind"] == "exact" else [(0, "regex", r["pattern"]), (1, "regex", r["pattern"])]) for r in entries]
    found = first_text_match(ledger, texts, tests, "_entry")
    found = with_values(found, "_entry", {r["entry_idx"]: (r["canonical"],) for r in entries}, ("_name",))
    manual = (F.col("merchant_source") == "manual") & F.col("canonical_merchant").isNotNull() & (F.col("canonical_merchant") != "")
    manual = F.coalesce(manual, F.lit(False))
    return found.withColumns({
        "canonical_merchant": F.when(manual, F.col("canonical_merchant")).otherwise(F.col("_name")),
        "merchant_source": F.when(manual, "manual").when(F.col("_entry").isNotNull(), "alias").otherwise("none"),
    }).drop("_entry", "_name")


def merchant_defaults(aliases: DataFrame) -> DataFrame:
    """(canonical, category, subcategory) of entries with a category; of equal names the last."""
    last = F.max_by(F.struct("category", F.coalesce("subcategory", F.lit("")).alias("subcategory")), "entry_idx")
    return aliases.where("category is not null and category <> ''").groupBy("canonical").agg(last.alias("d")).select("canonical", "d.category", "d.subcategory")


def alias_patterns(clusters: DataFrame) -> DataFrame:
    """One alias row (canonical, kind, pattern) for each cluster (cluster_id, representative, members)."""
    from ..functions.text import escape, squeeze

    each = F.transform("members", lambda m: F.regexp_replace(escape(squeeze(m)), " ", r"\\s+"))
    return clusters.select("cluster_id", F.col("representative").alias("canonical"), F.lit("regex").alias("kind"), F.concat(F.lit("(?i)"), F.array_join(each, "|")).alias("pattern"))


def stamp_canonical(ledger: DataFrame, members: DataFrame, canonical: str) -> DataFrame:
    """Rows whose normalized name is among `members` (normalized_merchant) get the name by hand; proposals are cleared."""
    hit = ledger.join(members.select("normalized_merchant").distinct().withColumn("_hit", F.lit(True)), "normalized_merchant", "left")
    on = F.coalesce("_hit", F.lit(False))
    return hit.withColumns({
        "canonical_merchant": F.when(on, canonical).otherwise(F.col("canonical_merchant")),
        "merchant_source": F.when(on, "manual").otherwise(F.col("merchant_source")),
        "proposed_canonical": F.when(~on, F.col("proposed_canonical")),
    }).drop("_hit").select(*ledger.columns)


def merchant_usage(ledger: DataFrame, aliases: DataFrame) -> DataFrame:
    """(canonical, alias_count, txn_count, total_amount) of each dictionary entry, zeros if unused."""
    entries = aliases.groupBy("canonical").agg(F.count("pattern").alias("alias_count"), F.min("entry_idx").alias("entry_idx"))
    used = ledger.where("canonical_merchant is not null").groupBy(F.col("canonical_merchant").alias("canonical")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return entries.join(used, "canonical", "left").select("canonical", "alias_count", F.coalesce("n", F.lit(0)).alias("txn_count"), F.coalesce("total", F.lit(0)).cast("decimal(28,2)").alias("total_amount"))


def recanonicalize(ledger: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger canonicalized anew, and how many rows have a name now."""
    out = canonicalize(ledger, aliases)
    return out, out.agg(F.count("canonical_merchant").alias("resolved"))
