"""The queue of proposals: profiles, scoring by any function, sanitising, merging, applying and rolling back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squeeze, strip
from ..schema import PROPOSAL
from .classify import FINAL, is_open
from .cluster import cluster_unknowns

VERSION = "1"
BATCH = 20
NOTE = "Model returned a category label as the brand name."
PROFILE = "kind string, key string, members array<string>, txn_ids array<string>, sample_raw array<string>, txn_count bigint, total_amount decimal(28,2), history_category string, history_ratio double, history_count bigint, canonical string"
ANSWER = "key string, canonical string, category string, subcategory string, confidence string, reason string, ambiguous boolean"


def _samples(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, sample_raw): the first three different descriptors of each group; of each task's rows only three a group travel."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy("raw_description"))
    three = rows.select(*keys, "raw_description").where("raw_description is not null").distinct().withColumn("_n", first).where("_n <= 3")
    return three.groupBy(*keys).agg(F.array_sort(F.collect_list("raw_description")).alias("sample_raw"))


def merchant_profiles(ledger: DataFrame, threshold: float = 88) -> DataFrame:
    """Clusters of unknown merchants with sorted members, transactions, three samples; by the size of their total."""
    clusters = cluster_unknowns(ledger, threshold).select("cluster_id", "representative", "members", "txn_count", "total_amount")
    each = clusters.select("cluster_id", "representative", F.explode("members").alias("normalized_merchant"))
    rows = ledger.where("coalesce(canonical_merchant, '') = ''").select("normalized_merchant", "txn_id", "raw_description")
    names = ["cluster_id", "representative"]
    of_cluster = each.join(rows, "normalized_merchant")
    held = of_cluster.groupBy(*names).agg(F.array_sort(F.collect_list("txn_id")).alias("txn_ids"))
    out = clusters.join(held, names).join(_samples(of_cluster, *names), names, "left").withColumns({"members": F.array_sort("members"), "sample_raw": F.coalesce("sample_raw", F.array().cast("array<string>"))})
    return out.select(
        F.lit("merchant").alias("kind"), F.element_at("members", 1).alias("key"), "members", "txn_ids", "sample_raw", "txn_count", "total_amount",
        F.lit(None).cast("string").alias("history_category"), F.lit(0.0).alias("history_ratio"), F.lit(0).cast("bigint").alias("history_count"), F.lit(None).cast("string").alias("canonical"),
    ).orderBy(F.abs("total_amount").desc(), "key")


def category_profiles(ledger: DataFrame) -> DataFrame:
    """Open rows by merchant, with the category that settled rows of it agree on, if there are three."""
    canonical = strip(F.coalesce("canonical_merchant", F.lit("")))
    rows = ledger.withColumn("key", F.lower(F.when(canonical != "", canonical).otherwise(F.coalesce("normalized_merchant", F.lit("")))))
    settled = rows.where(F.col("category").isNotNull() & F.col("classified_by").isin(*FINAL))
    counts = settled.groupBy("key", "category").agg(F.count("*").alias("n"))
    history = counts.groupBy("key").agg(F.sum("n").alias("history_count"), F.min(F.struct((-F.col("n")).alias("back"), "category")).alias("top"))
    open_ = rows.where(is_open()).groupBy("key").agg(
        F.min(F.struct("txn_id", F.coalesce(F.when(canonical != "", canonical), F.col("normalized_merchant")).alias("merchant"), F.when(canonical != "", canonical).alias("canonical"))).alias("one"),
        F.array_sort(F.collect_list("txn_id")).alias("txn_ids"), F.count("*").alias("txn_count"), F.sum("amount").cast("decimal(28,2)").alias("total_amount"),
    )
    enough = F.coalesce(F.col("history_count") >= 3, F.lit(False))
    open_ = open_.join(_samples(rows.where(is_open()), "key"), "key", "left").withColumn("sample_raw", F.coalesce("sample_raw", F.array().cast("array<string>")))
    return open_.join(history, "key", "left").select(
        F.lit("category").alias("kind"), "key", F.array("one.merchant").alias("members"), "txn_ids", "sample_raw", "txn_count", "total_amount",
        F.when(enough, F.col("top.category")).alias("history_category"), F.when(enough, F.round(-F.col("top.back") / F.col("history_count"), 3)).otherwise(0.0).alias("history_ratio"),
        F.coalesce("history_count", F.lit(0)).alias("history_count"), F.col("one.canonical").alias("canonical"),
    ).orderBy(F.abs("total_amount").desc(), "key")


def _agreed() -> Column:
    return F.col("history_category").isNotNull() & (F.col("history_ratio") >= 0.9) & (F.col("history_count") >= 3)


def history_answers(profiles: DataFrame) -> DataFrame:
    """Ready answers for profiles whose history agrees to nine tenths."""
    share = F.concat(F.round(F.col("history_ratio") * 100).cast("int").cast("string"), F.lit("%"))
    return profiles.where(_agreed()).withColumns({
        "answer_canonical": F.lit(""), "category": F.col("history_category"), "subcategory": F.lit(""), "confidence": F.lit("high"), "ambiguous": F.lit(False),
        "reason": F.concat(F.col("history_count").cast("string"), F.lit(" reviewed transactions agree "), share, F.lit(".")),
    })


def score_profiles(profiles: DataFrame, fn: Callable[[list[dict]], list[dict]], batch: int = BATCH) -> DataFrame:
    """Ask fn about batches of profiles. A profile without an answer, or in a batch that failed, gets a low, ambiguous one."""
    names = [p.split()[0] for p in ANSWER.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                try:
                    answers = {str(a.get("key")): a for a in fn(part.to_dict("records"))}
                    missing = "No model answer."
                except Exception as problem:  # noqa: BLE001  other batches go on
                    answers, missing = {}, f"batch failed: {problem}"
                rows = [{"confidence": "low", **answers.get(k, {"ambiguous": True, "reason": missing}), "key": k} for k in part["key"]]
                yield pd.DataFrame([{n: r.get(n, "" if n != "ambiguous" else False) for n in names} for r in rows], columns=names)

    asked = profiles.select("key", "members", "sample_raw", "txn_count", F.col("total_amount").cast("double").alias("total_amount"), "history_category", "history_ratio")
    answers = asked.mapInPandas(run, ANSWER).withColumnRenamed("canonical", "answer_canonical")
    return profiles.join(answers, "key")


def sanitize_answers(df: DataFrame, categories: list[str], brand: str = "answer_canonical") -> DataFrame:
    """No category labels as brands (the category is recovered from them if it has none), no unknown categories; an empty
    brand is taken from the first quoted phrase of up to eight words in the reason that is no label."""
    allowed = [c.lower() for c in categories]
    extra = ["gas", "retail", "fastfood"]
    name, category, reason = (strip(F.coalesce(c, F.lit(""))) for c in (brand, "category", "reason"))

    def is_label(text: Column) -> Column:
        folded = F.lower(squeeze(text))
        parts = F.filter(F.transform(F.split(folded, r"/|\||\sor\s"), lambda p: F.trim(p)), lambda p: p != "")
        several = folded.rlike(r"/|\||\sor\s") & (F.size(parts) > 0) & F.forall(parts, lambda p: p.isin(allowed + extra))
        return (folded != "") & (folded.isin(allowed) | several)

    df = df.withColumns({"_label": is_label(name), "_name": name, "_category": category})
    pairs = [F.lit(x) for c in categories for x in (c.lower(), c)]
    meant = F.try_element_at(F.create_map(*pairs), F.lower(squeeze("_name"))) if pairs else F.lit(None).cast("string")
    chosen = F.when(F.col("_label") & (F.col("_category") == ""), F.coalesce(meant, F.lit(""))).otherwise(F.col("_category"))
    df = df.withColumn("_category", chosen).withColumn("_bad", (F.col("_category") != "") & ~F.col("_category").isin(categories))
    quoted = F.transform(F.regexp_extract_all(reason, F.lit(r"[\"'“‘]([^\"'“”‘’]+)[\"'”’]"), 1), lambda t: strip(t))
    usable = F.filter(quoted, lambda t: (t != "") & ~is_label(t) & (F.size(F.split(squeeze(t), " ")) <= 8))
    kept = F.when(F.col("_label"), "").otherwise(F.col("_name"))
    wrong = F.col("_label") | F.col("_bad")
    return df.withColumns({
        brand: F.when(kept == "", F.coalesce(F.try_element_at(usable, F.lit(1)), F.lit(""))).otherwise(kept),
        "subcategory": F.when(F.col("_bad") | (F.col("_category") == ""), "").otherwise(strip(F.coalesce("subcategory", F.lit("")))),
        "category": F.when(F.col("_bad"), "").otherwise(F.col("_category")),
        "confidence": F.when(wrong, "low").otherwise(F.lower(F.coalesce("confidence", F.lit("low")))),
        "ambiguous": F.coalesce("ambiguous", F.lit(False)) | wrong,
        "reason": F.when(F.col("_label"), F.trim(F.concat_ws(" ", reason, F.lit(NOTE)))).otherwise(reason),
    }).drop("_label", "_name", "_category", "_bad")


def fingerprint(df: DataFrame) -> Column:
    """24 hex digits of what a proposal was made from: members and samples, or key, transactions and history."""
    merchant = F.to_json(F.struct("members", "sample_raw"))
    category = F.to_json(F.struct("history_category", "history_ratio", "key", F.array_sort("txn_ids").alias("txn_ids")))
    return F.substring(F.sha2(F.concat_ws("|", F.lit(VERSION), "kind", F.when(F.col("kind") == "merchant", merchant).otherwise(category)), 256), 1, 24)


def make_proposals(answered: DataFrame, model: str, now: str) -> DataFrame:
    """Answered profiles as rows of the queue."""
    recommendation = F.when(F.col("kind") == "merchant", F.to_json(F.struct(F.col("answer_canonical").alias("canonical"), "category", "subcategory"))).otherwise(
        F.to_json(F.struct("category", "subcategory", F.col("canonical").alias("canonical"), _agreed().alias("reusable")))
    )
    evidence = F.to_json(F.struct("reason", "ambiguous", "sample_raw", "txn_count", F.col("total_amount").cast("double").alias("total_amount"), "history_category", "history_ratio"))
    print_ = fingerprint(answered)
    values = {
        "proposal_id": F.substring(F.sha2(F.concat_ws("|", print_, F.lit(now)), 256), 1, 16), "input_fingerprint": print_, "kind": F.col("kind"), "status": F.lit("pending"),
        "members_json": F.to_json("members"), "txn_ids_json": F.to_json("txn_ids"), "recommendation_json": recommendation, "evidence_json": evidence,
        "confidence": F.when(F.coalesce("ambiguous", F.lit(False)), "low").otherwise(F.lower("confidence")), "model": F.lit(model), "prompt_version": F.lit(VERSION),
        "batch_id": F.lit(None), "created_at": F.lit(now), "updated_at": F.lit(now), "error": F.lit(None),
    }
    return answered.select(*[values[c].cast("string").alias(c) for c in PROPOSAL])


def apply_scores(ledger: DataFrame, answers: DataFrame, categories: list[str]) -> DataFrame:
    """Row form: answers (txn_id, category, subcategory) become proposals of the rows, marked `ai`; a category outside the
    vocabulary is Uncategorized."""
    a = answers.select("txn_id", F.when(F.col("category").isin(categories), F.col("category")).otherwise("Uncategorized").alias("_category"), F.coalesce("subcategory", F.lit("")).alias("_subcategory")).dropDuplicates(["txn_id"])
    on = F.col("_category").isNotNull() & ~F.coalesce("classified_by", F.lit("")).isin(*FINAL)
    out = ledger.join(a, "txn_id", "left").withColumns({
        "proposed_category": F.when(on, F.col("_category")).otherwise(F.col("proposed_category")), "proposed_subcategory": F.when(on, F.col("_subcategory")).otherwise(F.col("proposed_subcategory")),
        "category": F.when(on, F.col("_category")).otherwise(F.col("category")), "subcategory": F.when(on, F.col("_subcategory")).otherwise(F.col("subcategory")),
        "classified_by": F.when(on, "ai").otherwise(F.col("classified_by")),
    })
    return out.select(*ledger.columns)


def propose_canonical(ledger: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster form: (members, canonical) fills proposed_canonical of unknown rows."""
    each = clusters.where("coalesce(canonical, '') <> ''").select(F.explode("members").alias("normalized_merchant"), F.col("canonical").alias("_name")).dropDuplicates(["normalized_merchant"])
    unknown = F.coalesce("canonical_merchant", F.lit("")) == ""
    return ledger.join(each, "normalized_merchant", "left").withColumn("proposed_canonical", F.when(unknown & F.col("_name").isNotNull(), F.col("_name")).otherwise(F.col("proposed_canonical"))).select(*ledger.columns)


def merge_proposals(existing: DataFrame, created: DataFrame, mode: str = "full") -> DataFrame:
    """full: the waiting ones (pending, deferred) go, the new ones come. incremental: new ones that already wait are left
    out."""
    waiting = F.col("status").isin("pending", "deferred")
    if mode == "full":
        return existing.where(~waiting).unionByName(created)
    if mode != "incremental":
        raise ValueError(f"no mode {mode!r}")
    return existing.unionByName(created.join(existing.where(waiting).select("input_fingerprint"), "input_fingerprint", "left_anti").select(*existing.columns))


def list_proposals(proposals: DataFrame, status: str | None = "pending", kind: str | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "low", 2).otherwise(3)
    impact = F.abs(F.coalesce(F.get_json_object("evidence_json", "$.total_amount").try_cast("double"), F.lit(0.0)))
    rows = proposals
    for c, want in (("status", status), ("kind", kind)):
        if want:
            rows = rows.where(F.col(c) == want)
    return rows.withColumns({"confidence_rank": rank, "impact": impact}).orderBy("confidence_rank", F.desc("impact"), F.desc("created_at"), "proposal_id").offset(offset).limit(limit)


def invalid_decisions(proposals: DataFrame, decisions: DataFrame, categories: list[str]) -> DataFrame:
    """Decisions (proposal_id, action, recommendation_json, save_as_rule) that can't be applied, with the reason."""
    p = proposals.select("proposal_id", "status", "kind", F.col("recommendation_json").alias("_own"))
    d = decisions.join(p, "proposal_id", "left")
    what = F.coalesce("recommendation_json", "_own")
    name, category = (F.coalesce(F.get_json_object(what, f"$.{k}"), F.lit("")) for k in ("canonical", "category"))
    accept = F.col("action") == "accept"
    problem = (
        F.when(F.col("status").isNull(), "no such proposal").when(~F.col("action").isin("accept", "reject", "defer"), "no such action").when(~F.col("status").isin("pending", "deferred"), "already decided")
        .when(accept & (F.col("kind") == "merchant") & (strip(name) == ""), "no brand").when(accept & (F.col("kind") == "category") & (category == ""), "no category")
        .when(accept & (category != "") & ~category.isin(categories), "no such category")
    )
    return d.withColumn("problem", problem).where("problem is not null").select("proposal_id", "problem")


def apply_proposals(ledger: DataFrame, proposals: DataFrame, decisions: DataFrame, categories: list[str], batch_id: str, now: str) -> dict[str, DataFrame]:
    """ledger, proposals, new aliases and new rules after a batch of decisions; any invalid one fails the whole batch."""
    wrong = invalid_decisions(proposals, decisions, categories).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['proposal_id']}: {r['problem']}" for r in wrong))
    d = decisions.select("proposal_id", "action", F.col("recommendation_json").alias("_new"), "save_as_rule")
    taken = proposals.join(d, "proposal_id").withColumn("_what", F.coalesce("_new", "recommendation_json")).where("action = 'accept'")
    taken = taken.select("proposal_id", "kind", "members_json", "txn_ids_json", "save_as_rule", *[F.coalesce(F.get_json_object("_what", f"$.{k}"), F.lit("")).alias(f"_{k}") for k in ("canonical", "category", "subcategory")])
    by_name = taken.where("kind = 'merchant'").select(F.explode(F.from_json("members_json", "array<string>")).alias("normalized_merchant"), F.col("_canonical").alias("_m"), F.col("_category").alias("_mc"), F.col("_subcategory").alias("_ms")).dropDuplicates(["normalized_merchant"])
    by_id = taken.where("kind = 'category'").select(F.explode(F.from_json("txn_ids_json", "array<string>")).alias("txn_id"), F.col("_category").alias("_c"), F.col("_subcategory").alias("_s")).dropDuplicates(["txn_id"])
    named, filed, also = F.col("_m").isNotNull(), F.col("_c").isNotNull(), F.coalesce(F.col("_mc") != "", F.lit(False))
    out = ledger.join(by_name, "normalized_merchant", "left").join(by_id, "txn_id", "left").withColumns({
        "canonical_merchant": F.when(named, F.col("_m")).otherwise(F.col("canonical_merchant")), "merchant_source": F.when(named, "manual").otherwise(F.col("merchant_source")),
        "proposed_canonical": F.when(~named, F.col("proposed_canonical")),
        "category": F.when(filed, F.col("_c")).when(also, F.col("_mc")).otherwise(F.col("category")), "subcategory": F.when(filed, F.col("_s")).when(also, F.col("_ms")).otherwise(F.col("subcategory")),
        "classified_by": F.when(filed | also, "manual").otherwise(F.col("classified_by")),
        "proposed_category": F.when(~(filed | also), F.col("proposed_category")), "proposed_subcategory": F.when(~(filed | also), F.col("proposed_subcategory")),
    }).select(*ledger.columns)
    status = F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected").when(F.col("action") == "defer", "deferred")
    decided = proposals.join(d, "proposal_id", "left").withColumns({
        "status": F.coalesce(status, "status"), "recommendation_json": F.coalesce("_new", "recommendation_json"),
        "batch_id": F.when(F.col("action").isNotNull(), batch_id).otherwise(F.col("batch_id")), "updated_at": F.when(F.col("action").isNotNull(), now).otherwise(F.col("updated_at")),
    }).select(*proposals.columns)
    from ..functions.text import escape

    members = F.transform(F.from_json("members_json", "array<string>"), lambda m: F.regexp_replace(escape(squeeze(m)), " ", r"\\s+"))
    aliases = taken.where("kind = 'merchant'").select(F.col("_canonical").alias("canonical"), F.lit("regex").alias("kind"), F.concat(F.lit("(?i)"), F.array_join(members, "|")).alias("pattern"), F.col("_category").alias("category"), F.col("_subcategory").alias("subcategory"))
    rules = taken.where("save_as_rule").select(F.when(F.col("kind") == "merchant", "canonical").otherwise(F.when(F.col("_canonical") != "", "canonical").otherwise("exact")).alias("kind"), F.when(F.col("_canonical") != "", F.col("_canonical")).otherwise(F.from_json("members_json", "array<string>")[0]).alias("pattern"), F.col("_category").alias("category"), F.col("_subcategory").alias("subcategory")).where("category <> ''")
    return {"ledger": out, "proposals": decided, "aliases": aliases, "rules": rules}


def rollback_proposals(proposals: DataFrame, batch_id: str, now: str) -> DataFrame:
    """Proposals of a batch wait again; the ledger's earlier version is read from its store."""
    hit = F.coalesce(F.col("batch_id") == batch_id, F.lit(False))
    return proposals.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "batch_id": F.when(~hit, F.col("batch_id"))})
