from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cardloom.functions.text import rule_pattern, title_if_upper
from cardloom.operators import classify, cluster, coverage, identity, ledgerqa, maintenance, matching, merchants, overview, proposals, recurring, reports
from cardloom.schema import LEDGER, conform

RAW = "card string, posted_date date, amount decimal(18,2), raw_description string, source_document_id string, source_file string, source_row bigint"


def raw(spark, *rows):
    return spark.createDataFrame([(c, date.fromisoformat(d), Decimal(a), t, doc, f, r) for c, d, a, t, doc, f, r in rows], RAW)


def ledger(spark, *rows):
    names = sorted({k for r in rows for k in r})
    base = [{**r, "posted_date": date.fromisoformat(r.get("posted_date", "2026-07-01")), "amount": Decimal(str(r["amount"])), "txn_id": r.get("txn_id", f"t{i:03d}")} for i, r in enumerate(rows)]
    names = sorted(set(names) | {"posted_date", "amount", "txn_id"})
    ddl = ", ".join(f"{n} {LEDGER[n]}" for n in names)
    return conform(spark.createDataFrame([tuple(r.get(n) for n in names) for r in base], ddl))


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "x string").select(fn("x")).first()[0]


def test_overlapping_documents_count_as_a_multiset(spark):
    rows = raw(spark, ("c", "2026-01-02", "4.25", "COFFEE CART", "a", "a.csv", 1), ("c", "2026-01-02", "4.25", "COFFEE CART ", "a", "a.csv", 2), ("c", "2026-01-02", "4.25", "COFFEE CART", "b", "b.csv", 1))
    found = identity.normalize(rows).collect()
    assert sorted(r["source_occurrence"] for r in found) == [0, 1]
    assert all(len(r["txn_id"]) == 16 for r in found) and len({r["txn_id"] for r in found}) == 2
    assert identity.transaction_sources(rows).count() == 3
    again, fresh = maintenance.append_new(identity.normalize(rows), identity.normalize(rows))
    assert (again.count(), fresh.count()) == (2, 0)


def test_missing_amount_fails(spark):
    rows = raw(spark, ("c", "2026-01-02", "1.00", "A", "a", "a", 1)).withColumn("amount", F.lit(None).cast("decimal(18,2)"))
    with pytest.raises(Exception, match="no amount"):
        identity.normalize(rows).collect()


@pytest.mark.parametrize(("text", "want"), [("APLPAY ORCA 00SJFQR SEATTLE WA", "ORCA 00SJFQR"), ("CAVA EAST COBB MARIETTA GA", "CAVA EAST COBB"), ("APLPAY", "APLPAY"), ("", "UNKNOWN"), (None, "UNKNOWN")])
def test_identity_key(spark, text, want):
    assert one(spark, text, identity.merchant_identity_key) == want


@pytest.mark.parametrize(("text", "want"), [("wal*mart #1234 us", "WAL MART"), ("Café ١٢٣٤ US", "CAFÉ"), ("a b c d e f g", "A B C D E F"), ("  ", "UNKNOWN"), (None, "UNKNOWN"), ("STORE 12 X", "X")])
def test_normalize_merchant(spark, text, want):
    assert one(spark, text, identity.normalize_merchant) == want


def test_aliases_rules_and_locks(spark):
    aliases = spark.createDataFrame([(0, "Walmart", "regex", r"(?i)wal[-\s]?mart", "Shopping", "Retail"), (1, "Bad", "regex", "(", None, None), (2, "Cafe", "exact", "blue door", "Food", None)], "entry_idx int, canonical string, kind string, pattern string, category string, subcategory string")
    rules = spark.createDataFrame([(0, "canonical", "CAFE", "Fun", "Coffee"), (1, "regex", "(?i)door", "Never", "")], "rule_idx int, kind string, pattern string, category string, subcategory string")
    rows = ledger(
        spark, {"amount": 1, "normalized_merchant": "WAL-MART", "raw_description": "WAL-MART"}, {"amount": 1, "normalized_merchant": "BLUE DOOR", "raw_description": "x"},
        {"amount": 1, "normalized_merchant": "WALMART", "canonical_merchant": "Mine", "merchant_source": "manual", "category": "Kept", "classified_by": "manual"}, {"amount": 1, "normalized_merchant": "ZZZ"},
    )
    got = {r["txn_id"]: (r["canonical_merchant"], r["merchant_source"], r["category"], r["subcategory"], r["classified_by"]) for r in classify.classify_ledger(rows, aliases, rules).collect()}
    assert got == {"t000": ("Walmart", "alias", "Shopping", "Retail", "merchant"), "t001": ("Cafe", "alias", "Fun", "Coffee", "rule"), "t002": ("Mine", "manual", "Kept", None, "manual"), "t003": (None, "none", None, None, None)}
    assert merchants.merchant_defaults(aliases).count() == 2
    usage = {r["canonical"]: r["txn_count"] for r in merchants.merchant_usage(merchants.canonicalize(rows, aliases), aliases).collect()}
    assert usage == {"Walmart": 1, "Bad": 0, "Cafe": 1}


def test_clusters_equal_the_global_greedy_run(spark):
    import random

    random.seed(5)
    names = [" ".join(random.choice(["RED", "BLUE", "OLD", "SHOP", "CAFE", "NORTH", "EAST", "BAR"]) for _ in range(random.randint(1, 4))) for _ in range(60)]
    amounts = [round(random.uniform(1, 99), 2) for _ in names]
    rows = ledger(spark, *[{"amount": a, "normalized_merchant": n, "raw_description": n} for n, a in zip(names, amounts)])
    got = {frozenset(r["members"]) for r in cluster.cluster_unknowns(rows, 80).collect()}
    total = {n: sum(a for m, a in zip(names, amounts) if m == n) for n in set(names)}
    key = dict(rows.select("normalized_merchant", identity.merchant_identity_key("normalized_merchant")).distinct().collect())
    groups = []
    for n in sorted(total, key=lambda n: (-round(total[n], 2), n)):
        for g in groups:
            if key[g[0]].split()[0] == key[n].split()[0] and cluster.token_set_ratio(key[g[0]], key[n]) >= 80:
                g.append(n)
                break
        else:
            groups.append([n])
    assert got == {frozenset(g) for g in groups}


@pytest.mark.parametrize("chunk", [3, 7, 2_048])
def test_a_hot_block_runs_in_rounds(spark, monkeypatch, chunk):
    """Many keys of one first word, and few of others, whatever the number of keys a task may compare."""
    import random

    random.seed(6)
    words = ["NORTH", "NORTHE", "EAST", "EASTS", "BAR", "CAFE", "CAFES", "SHOP", "OLD", "1"]
    keys = sorted({" ".join(["ACME" if random.random() < 0.8 else random.choice(["ZED", "YAM"]), *random.sample(words, random.randint(0, 3))]) for _ in range(90)})
    rows = [(k, float(-random.randint(1, 9)), k, k.split()[0]) for k in keys]
    got = dict(cluster._led(spark.createDataFrame(rows, "key string, back double, name string, block string"), 88, chunk).collect())
    want, leaders = {}, []
    for key, _, _, block in sorted(rows, key=lambda r: (r[1], r[2])):
        want[key] = next((x for x in leaders if x.split()[0] == block and cluster.token_set_ratio(x, key) >= 88), key)
        if want[key] == key:
            leaders.append(key)
    assert got == want and 8 < len(leaders) < len(keys)


def test_token_set_ratio():
    assert cluster.token_set_ratio("LOCAL COFFEE ROASTERS DOWNTOWN", "LOCAL COFFEE ROASTERS") == 100
    assert round(cluster.token_set_ratio("new york mets", "new york meats"), 1) == 96.3
    assert cluster.token_set_ratio("", "a") == 0


def test_month_overview(spark):
    rows = ledger(
        spark, {"amount": 40, "posted_date": "2026-07-02", "category": "Food", "cardholder": "Alex"}, {"amount": -200, "posted_date": "2026-07-03"}, {"amount": 25, "posted_date": "2026-06-02", "category": "Food"},
        {"amount": 60, "posted_date": "2026-07-05", "category": "Transport", "tags": ["beach", "work"]}, {"amount": 200, "posted_date": "2026-07-06", "normalized_merchant": "BIG", "category": " "},
    )
    s = overview.month_summary(rows).first()
    assert (s["month"], s["spend_total"], s["payments_and_refunds"], s["prior_spend_total"], s["spend_delta"], s["uncategorized_total"]) == ("2026-07", 300.0, 200.0, 25.0, 275.0, 200.0)
    assert overview.month_summary(rows, "2026-06").first()["spend_delta"] is None
    by = {(r["month"], r["cardholder"]): r["spend_total"] for r in overview.month_summaries(rows).collect()}
    assert by[("2026-07", None)] == 300.0 and by[("2026-07", "Alex")] == 40.0
    deltas = {r["category"]: (r["total"], r["prior_total"], r["delta"]) for r in overview.month_category_deltas(rows).collect()}
    assert deltas == {"Food": (40.0, 25.0, 15.0), "Transport": (60.0, 0.0, 60.0), "Uncategorized": (200.0, 0.0, 200.0)}
    assert [r["merchant"] for r in overview.large_charges(rows).collect()] == ["BIG"]
    assert {r["name"]: float(r["total"]) for r in overview.month_holders(rows).collect()} == {"Unassigned": 260.0, "Alex": 40.0}
    assert overview.month_holders(rows, None, "Alex").count() == 0
    tags = spark.createDataFrame([("beach", "Beach", "trip"), ("work", "Work", "other")], "id string, label string, kind string")
    assert [(r["id"], float(r["total"])) for r in overview.tag_spend(rows, tags).collect()] == [("beach", 60.0)]


def test_recurring_and_bills(spark):
    rows = ledger(spark, *[{"amount": 2100, "posted_date": f"2026-0{m}-20", "normalized_merchant": "RENT CO", "raw_description": "RENT CO", "category": "Housing"} for m in (1, 2, 3)], {"amount": 5, "normalized_merchant": "ONCE"})
    found = recurring.recurring(rows).collect()
    assert [(r["normalized_merchant"], r["is_recurring"], r["occurrences"], r["median_gap_days"]) for r in found] == [("RENT CO", True, 3, 29.5)]
    bills = spark.createDataFrame([(0, "Rent", "(?i)rent", 2000.0), (1, "Power", "(?i)power", None), (2, "Off", "(?i)once", 50.0)], "bill_idx int, name string, merchant_regex string, expected_amount double")
    got = {r["bill"]: (r["status"], r["matched_avg"], r["last_seen"]) for r in recurring.reconcile_bills(rows, bills).collect()}
    assert got == {"Rent": ("matched", 2100.0, "2026-03-20"), "Power": ("missing", None, None), "Off": ("amount_mismatch", 5.0, "2026-07-01")}
    assert recurring.reconcile_bills(rows.limit(0), bills).count() == 0
    assert {r["bill"]: r["status"] for r in overview.bills_seen(rows, bills, "2026-03").collect()} == {"Rent": "seen", "Power": "missing", "Off": "missing"}


def test_coverage(spark):
    doc = lambda d, a, b: [{"amount": 5, "posted_date": x, "card_issuer": "Chase", "card_product": "Gold", "source_document_id": d} for x in (a, b)]
    rows = ledger(spark, *doc("d1", "2026-01-01", "2026-01-20"), *doc("d2", "2026-03-04", "2026-03-20"))
    products = spark.createDataFrame([("Chase", "Gold"), ("Amex", "Blue")], "issuer string, product string")
    got = {(r["issuer"], r["product"]): r for r in coverage.cards_coverage(rows, products, date(2026, 3, 25)).collect()}
    gap = got[("Chase", "Gold")]["gaps"]
    assert [g["days"] for g in gap] == [43] and got[("Chase", "Gold")]["status"] == "gap"
    assert got[("Amex", "Blue")]["status"] == "none" and got[("Chase", "Gold")]["label"] == "Chase Gold · Unassigned"
    late = coverage.cards_coverage(ledger(spark, *doc("d1", "2026-01-01", "2026-01-20")), products, date(2026, 3, 6)).where("issuer = 'Chase'").first()
    assert (late["status"], late["stale_days"]) == ("stale", 45)


def test_spend_questions(spark):
    rows = ledgerqa.project_ledger_view(ledger(
        spark, {"amount": 40, "canonical_merchant": "Amazon", "posted_date": "2023-08-12"}, {"amount": "13.11", "canonical_merchant": "Amazon", "posted_date": "2023-08-13"}, {"amount": -5, "canonical_merchant": "Amazon"},
        {"amount": 80, "canonical_merchant": "Target", "category": "Shopping"}, {"amount": 3, "normalized_merchant": "AMEX FEE", "category": "Fees"},
    ))
    s = ledgerqa.merchant_spend(rows, "AMAZON").first()
    assert (s["gross_charges"], s["credits_refunds"], s["net_spend"], s["charge_count"], s["ambiguous"]) == (53.11, 5.0, 48.11, 2, False)
    assert ledgerqa.merchant_spend(rows, "am").first()["ambiguous"]
    assert ledgerqa.merchant_spend(rows, "amazon", since="2023-08-13").first()["gross_charges"] == 13.11
    assert ledgerqa.category_spend(rows, "shop").first()["gross_charges"] == 80.0
    assert ledgerqa.category_spend(rows, "fees").first()["gross_charges"] == 3.0
    assert ledgerqa.category_spend(rows, "none").first()["charge_count"] == 0
    assert [r["name"] for r in ledgerqa.matched_names(rows, "a", 1).orderBy("place").collect()] == ["Target", "+2 more"]
    replies = spark.createDataFrame([("You spent $99,999.00.", '{"net": 12.0}'), ("$12.00 across 1 charges", '{"net": 12.0}'), ("In 2024, 3 times", '{"y": "2024"}'), ("In 2023", '{"y": 1}')], "reply string, facts_json string")
    assert [r["grounded"] for r in ledgerqa.grounded_replies(replies).collect()] == [False, True, True, False]


def test_search(spark):
    rows = ledger(spark, {"amount": 4, "raw_description": "Coffee (50%)", "tags": ["date"]}, {"amount": 5, "raw_description": "tea", "category": "Food", "classified_by": "rule"})
    assert ledgerqa.search_ledger(rows, q="COFFEE (50%")[1].first()[0] == 1
    assert ledgerqa.search_ledger(rows, tag="date")[1].first()[0] == 1
    assert ledgerqa.search_ledger(rows, category="Uncategorized", unclassified=True)[0].count() == 1


def test_reports_and_redaction(spark):
    rows = ledger(spark, {"amount": 4, "category": "Food", "normalized_merchant": "A", "source_file": "/x"}, {"amount": 6, "normalized_merchant": "B"}, {"amount": -3, "normalized_merchant": "B"})
    assert [(r["category"], float(r["total"])) for r in reports.category_totals(rows).collect()] == [("Uncategorized", 6.0), ("Food", 4.0)]
    found = reports.exports(rows, recurring.recurring(rows), recurring.reconcile_bills(rows, spark.createDataFrame([(0, "n", "(?i)a", None)], "bill_idx int, name string, merchant_regex string, expected_amount double")))
    assert set(found) == {"category_monthly", "summary", "recurring", "reconciliation"}
    assert {r["bill"] for r in found["reconciliation"].collect()} == {"Expected bill"}
    assert "source_file" not in reports.exports(rows, found["recurring"], found["reconciliation"], "full")["ledger"].columns
    assert reports.status_counts(rows).first()["unknown_merchants"] == 2


def test_review(spark):
    rows = ledger(spark, {"amount": 4, "raw_description": "BIKE SHOP"}, {"amount": 9, "raw_description": "BIKE", "category": "X", "classified_by": "ai"}, {"amount": 1, "raw_description": "BIKE", "category": "Y", "classified_by": "rule"})
    queue = classify.review_queue(rows, 1).collect()
    assert [(r["txn_id"], r["queue_total"]) for r in queue] == [("t001", 2)]
    done = classify.apply_rule_to_open(rows, {"kind": "regex", "pattern": "(?i)bike", "category": "Fun"})
    assert {r["txn_id"] for r in done.where("changed").collect()} == {"t000", "t001"}
    decisions = spark.createDataFrame([("t000", "Food", None, ["gift"]), ("nope", "Food", None, None)], "txn_id string, category string, subcategory string, tags array<string>")
    out, unknown = classify.apply_review_decisions(rows, decisions)
    assert [r["txn_id"] for r in unknown.collect()] == ["nope"]
    assert out.where("txn_id = 't000'").select("category", "subcategory", "tags", "classified_by").first() == ("Food", "", ["gift"], "manual")
    tags = spark.createDataFrame([(["a", " a ", "nan", ""], "x, y|x,,")], "t array<string>, s string").select(classify.clean_tags("t"), classify.split_tags("s")).first()
    assert tags == (["a"], ["x", "y", "x"])


def test_proposals(spark):
    rows = ledger(spark, *[{"amount": 3, "normalized_merchant": "ACME", "raw_description": "ACME 1"}] * 2, *[{"amount": 2, "canonical_merchant": "Cafe", "category": "Food", "classified_by": "manual"}] * 3, {"amount": 7, "canonical_merchant": "CAFE"})
    profiles = proposals.category_profiles(rows).where("key = 'cafe'")
    assert profiles.select("history_category", "history_ratio", "history_count").first() == ("Food", 1.0, 3)
    assert proposals.history_answers(profiles).first()["reason"] == "3 reviewed transactions agree 100%."

    def fail(_):
        raise RuntimeError("down")

    assert proposals.score_profiles(proposals.merchant_profiles(rows), fail).first()["confidence"] == "low"
    answers = spark.createDataFrame([("k", "Food / Gas", "", "", "high", 'Maybe "Best Shop" or "food".', False), ("l", "Brand", "Nonsense", "s", "high", "", False)], "key string, answer_canonical string, category string, subcategory string, confidence string, reason string, ambiguous boolean")
    clean = {r["key"]: r for r in proposals.sanitize_answers(answers, ["Food", "Travel"]).collect()}
    assert (clean["k"]["answer_canonical"], clean["k"]["confidence"]) == ("Best Shop", "low")
    assert (clean["l"]["answer_canonical"], clean["l"]["category"], clean["l"]["ambiguous"]) == ("Brand", "", True)

    def answer(items):
        return [{"key": p["key"], "canonical": "Acme Inc", "category": "Food", "confidence": "high", "reason": ""} for p in items]

    queue = proposals.make_proposals(proposals.sanitize_answers(proposals.score_profiles(proposals.merchant_profiles(rows), answer), ["Food"]), "m", "2026-01-01")
    assert queue.first()["confidence"] == "high"  # an answer that doesn't mention doubt has none
    assert proposals.merge_proposals(queue, queue, "incremental").count() == proposals.merge_proposals(queue, queue).count() == 1
    decision = queue.select("proposal_id", F.lit("accept").alias("action"), F.lit(None).cast("string").alias("recommendation_json"), F.lit(True).alias("save_as_rule"))
    out = proposals.apply_proposals(rows, queue, decision, ["Food"], "b1", "2026-01-02")
    assert out["ledger"].where("canonical_merchant = 'Acme Inc' and category = 'Food' and classified_by = 'manual'").count() == 2
    assert out["proposals"].first()["status"] == "accepted" and out["aliases"].count() == out["rules"].count() == 1
    with pytest.raises(ValueError, match="already decided"):
        proposals.apply_proposals(rows, out["proposals"], decision, ["Food"], "b2", "2026-01-03")
    assert proposals.rollback_proposals(out["proposals"], "b1", "2026-01-04").first()["status"] == "pending"


def test_large_numbers_in_facts(spark):
    """Facts as JSON write numbers from ten million on with an exponent."""
    rows = spark.createDataFrame([("$12,345,678.90", '{"net":1.23456789E7}'), ("$12,345,679.90", '{"net":1.23456789E7}')], "reply string, facts_json string")
    assert [r["grounded"] for r in ledgerqa.grounded_replies(rows).collect()] == [True, False]


def test_migration(spark):
    rows = identity.normalize(raw(spark, ("c", "2026-01-02", "4.25", "A", "a", "a.csv", 1), ("c", "2026-01-02", "4.25", "A", "a", "a.csv", 2)))
    assert not maintenance.needs_migration(rows).first()[0]
    old = rows.withColumns({"txn_id": F.concat(F.lit("x"), "txn_id"), "category": F.lit("Kept")}).drop("tags")
    assert maintenance.needs_migration(old).first()[0]
    again = maintenance.migrate_ids(old).collect()
    assert {r["txn_id"] for r in again} == {r["txn_id"] for r in rows.collect()} and {r["category"] for r in again} == {"Kept"}


def test_text(spark):
    assert one(spark, "JO ANN O'NEIL-FOX", title_if_upper) == "Jo Ann O'Neil-Fox" and one(spark, "Jo ann", title_if_upper) == "Jo ann"
    assert one(spark, "A–B’s", rule_pattern) == r"(?i)A\-B's"


def test_a_second_import_adds_no_undated_row(spark):
    raw = spark.createDataFrame(
        [("card-1", None, 4.25, "COFFEE CART", "doc-a", 0), ("card-1", "2026-01-02", 5.0, "COFFEE CART", "doc-a", 1), ("card-1", "2026-01-03", 6.0, "TEA", "doc-a", 2)],
        "card string, posted_date string, amount double, raw_description string, source_document_id string, source_row int",
    ).withColumns({"posted_date": F.col("posted_date").cast("date"), "amount": F.col("amount").cast("decimal(18,2)"), "source_file": F.lit("a.csv")})
    nothing = maintenance.ingest_rows(spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in LEDGER.items())), raw)[0]
    again, fresh = maintenance.ingest_rows(nothing, raw)
    assert nothing.count() == 3 and fresh.count() == 0 and again.count() == 3
    undated = raw.where("posted_date is null")
    assert maintenance.ingest_rows(nothing, undated)[1].count() == 0


def test_first_match_is_the_same_for_few_and_many_patterns(spark, monkeypatch):
    rows = spark.createDataFrame([("a b", 1), ("b c", 2), (None, 3), ("zzz", 4)], "text string, n int")
    tests = [(7, F.col("text").contains("b c")), (8, F.col("text").contains("b")), (9, F.col("text").isNull())]
    few = sorted((r["n"], r["hit"]) for r in matching.first_match(rows, ["text"], tests, "hit").collect())
    monkeypatch.setattr(matching, "CHAIN", 0)
    many = sorted((r["n"], r["hit"]) for r in matching.first_match(rows, ["text"], tests, "hit").collect())
    assert few == many == [(1, 8), (2, 7), (3, 9), (4, None)] or str(few) == str(many)


def test_the_ledger_is_built_with_a_single_exchange(spark):
    from cardloom.plans import testledger as t

    rows = raw(spark, ("c", "2026-01-02", "4.25", "A", "a", "a.csv", 1))
    plan = classify.classify_rows(identity.normalize(rows), t.aliases(spark), t.rules(spark))._jdf.queryExecution().optimizedPlan().toString()
    whole = identity.normalize(rows)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("Exchange hashpartitioning") == 1
    assert "Aggregate [txn_id" not in plan
    assert identity.transaction_sources(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rows_with_equal_ids_count_once(spark):
    # No card and an empty one give the same id, and so do these two with | in a card.
    rows = raw(spark, (None, "2026-01-02", "4.25", "A", "b", "b.csv", 1), ("", "2026-01-02", "4.25", "A", "a", "a.csv", 1), ("a", "2026-01-01", "5.00", "2026-02-02|6.00|x", "d", "d.csv", 1), ("a|2026-01-01|5.00", "2026-02-02", "6.00", "x", "c", "c.csv", 1))
    assert sorted(r["source_document_id"] for r in identity.normalize(rows).collect()) == ["a", "c"]


def test_plain_texts_give_the_same_names(spark):
    texts = ["  STORE 12 x", "#1\t#", "loc  7 us", "Üs us USA", "a  b c d e f g", "12345 a12345", "*", "", "ſtore 3", "x ", "us*us #é"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(identity.normalize_merchant("t")).collect()]
    assert got == ["X", "#", "UNKNOWN", "ÜS", "A B C D E F", "A12345", "UNKNOWN", "UNKNOWN", "UNKNOWN", "X", "É"]
