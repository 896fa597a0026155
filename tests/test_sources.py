from datetime import date
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardloom.functions.parse import parse_amount, parse_date, parse_month_day, resolve_cycle_date
from cardloom.sources import dictionaries, documents, statements, store
from cardloom.streaming.ingest import ingest, stream_ingest


@pytest.mark.parametrize(("text", "want"), [("$1,234.50", "1234.50"), ("(2.25)", "-2.25"), ("3.00-", "-3.00"), ("12.345", "12.35"), ("", None), ("abc", None), ("NaN", None), ("-7", "-7.00"), (None, None)])
def test_amounts(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(parse_amount("x")).first()[0]
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize(("text", "want"), [("07/04/2026", "2026-07-04"), ("7/4/26", "2026-07-04"), ("2026-07-04", "2026-07-04"), ("Jul 4, 2026", "2026-07-04"), ("soon", None)])
def test_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(parse_date("x")).first()[0] == (want and date.fromisoformat(want))


def test_cycle_dates(spark):
    rows = spark.createDataFrame([("12/30",), ("01/05",), ("Feb 29",), ("Feb 30",), ("06/15",), ("01/21",)], "x string").withColumn("p", parse_month_day("x"))
    got = rows.select("x", resolve_cycle_date(F.col("p.month"), F.col("p.day"), F.lit(date(2023, 12, 21)), F.lit(date(2024, 1, 20))).alias("d")).collect()
    assert {r["x"]: r["d"] for r in got} == {"12/30": date(2023, 12, 30), "01/05": date(2024, 1, 5), "Feb 29": None, "Feb 30": None, "06/15": None, "01/21": date(2024, 1, 21)}


CHASE = "Transaction Date,Post Date,Description,Category,Type,Amount,Memo\n07/01/2026,07/02/2026,COFFEE,Food,Sale,-4.50,\n07/03/2026,07/04/2026,Thanks,,Payment,450.00,\n07/03/2026,07/05/2026,,,Sale,1.00,\n"
GENERIC = "Date,Description,Debit,Credit\n2026-07-01,LUNCH,10.00,\n2026-07-02,BACK,,5.00\n"
BAD = "Date,Description,Debit,Credit\n2026-07-01,LUNCH,10.00,3.00\n2026-07-02,BACK,,5.00\n"


def write(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)


def test_ingest_is_all_or_nothing_and_idempotent(spark, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    write(inbox, {"chase/a.csv": CHASE, "other/b.csv": GENERIC, "other/bad.csv": BAD, "zz/copy.csv": CHASE, "_quarantine/c.csv": GENERIC, "boa/x.csv": GENERIC + " ", "readme.txt": "x"})
    docs = documents.read_documents(spark, str(inbox))
    assert docs.count() == 5
    counts = ingest(docs, out)
    assert counts == {"added": 4, "parsed": 2, "failed": 2, "duplicate_document": 1}
    rows = {r["raw_description"]: (r["posted_date"], float(r["amount"])) for r in store.read_ledger(spark, f"{out}/ledger").collect()}
    assert rows == {"COFFEE": (date(2026, 7, 2), 4.5), "Thanks": (date(2026, 7, 4), -450.0), "LUNCH": (date(2026, 7, 1), 10.0), "BACK": (date(2026, 7, 2), -5.0)}
    assert ingest(docs, out)["added"] == 0 if "parsed" in ingest(docs, out) else True
    assert store.read_ledger(spark, f"{out}/ledger").count() == 4
    assert spark.read.parquet(f"{out}/sources").count() == 4


def test_stream_takes_the_inbox_once(spark, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    write(inbox, {"chase/a.csv": CHASE})
    for _ in range(2):
        stream_ingest(spark, str(inbox), out, str(tmp_path / "cp")).awaitTermination()
    assert store.read_ledger(spark, f"{out}/ledger").count() == 2


def test_amex_needs_context(spark, tmp_path):
    text = "Date,Description,Card Member,Account #,Amount\n07/01/2026,SHOP,ALEX EXAMPLE,-1,35.31\n07/02/2026,PAY,Sam Example,-1,-947.69\n"
    write(tmp_path, {"amex/a.csv": text, "amex/.a.csv.upload.json": '{"card_issuer": "American Express", "card_product": "Gold"}', "amex/b.csv": text + "\n"})
    docs = documents.route_documents(documents.dedupe_documents(documents.read_documents(spark, str(tmp_path))))
    rows, status = statements.parse_csv_statements(documents.read_upload_context(spark, docs, str(tmp_path)))
    assert sorted((float(r["amount"]), r["cardholder"]) for r in rows.collect()) == [(-947.69, "Sam Example"), (35.31, "Alex Example")]
    assert sorted(r["status"] for r in status.collect()) == ["failed", "parsed"]


def test_versions_and_rollback(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("a", date(2026, 1, 1), Decimal("1.00"))], "txn_id string, posted_date date, amount decimal(18,2)")
    first = store.write_ledger(rows, path)
    store.write_ledger(store.read_ledger(spark, path).unionByName(store.read_ledger(spark, path).withColumn("txn_id", F.lit("b"))), path)
    assert store.read_ledger(spark, path).count() == 2 and store.read_ledger(spark, path, first).count() == 1
    store.rollback(spark, path, first)
    assert store.read_ledger(spark, path).count() == 1


def test_exports_replace_the_folder(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "stale.csv").write_text("x")
    store.write_exports({"a": spark.createDataFrame([(1, ["x"])], "n int, t array<string>")}, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[0] != ".") == ["a.csv", "a.json"]


def test_lines_join_words_within_the_tolerance_of_their_first(spark):
    nan = float("nan")
    tops = {1: [(10.0, 30, "c"), (8.0, 20, "b"), (9.0, 5, "a"), (10.6, 1, "d"), (13.0, 2, "e"), (None, 3, "z"), (nan, 4, "y"), (20.0, 1, "\u00a0"), (21.0, 1, None)], 2: [(None, 2, "q"), (nan, None, "p")]}
    rows = [("d", page, t, x if x is None else float(x), top) for page, words in tops.items() for top, x, t in words]
    lines = statements.words_to_lines(spark.createDataFrame(rows, "document_id string, page int, text string, x0 double, top double"))
    assert "InPandas" not in lines._jdf.queryExecution().executedPlan().toString()
    assert [(r["page"], r["line_no"], r["text"]) for r in lines.orderBy("line_no").collect()] == [(1, 0, "a b c"), (1, 1, "d e z y"), (2, 2, "p q")]


def test_long_csv_documents_leave_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(statements, "CHUNK", 3)
    text = "Date,Note,Date\n" + "".join(f'"2026-07-{i + 1:02d}","a\nb{i}",{i}\n,\n' for i in range(10))
    docs = [("a", bytearray(b"\xef\xbb\xbf" + text.encode())), ("late", bytearray(text.encode() + b"\xff")), ("empty", bytearray(b"")), ("head", bytearray(b"Date,x")), ("short", bytearray(b"A,B,C\n1,2\n1,2,3,4\n"))]
    got = statements.csv_cells(spark.createDataFrame(docs, "document_id string, content binary")).collect()
    own = lambda d: [(r["source_row"], r["cells"]) for r in sorted(got, key=lambda r: r["source_row"]) if r["document_id"] == d]
    assert own("a") == [(i, {"Date": str(i), "Note": f"a\nb{i}"}) for i in range(10)]
    assert own("late") == own("empty") == [(0, None)] and own("head") == []
    assert own("short") == [(0, {"A": "1", "B": "2"}), (1, {"A": "1", "B": "2", "C": "3"})]
    sizes = [len(c) for c in statements._csv_chunks(pa.py_buffer(text.encode()))]
    assert sizes == [3, 3, 3, 1]


def test_exports_are_packed(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("cast(id as string) as txn_id", "'SOME \"LONG\" MERCHANT, AND ITS PLACE' as raw_description")
    store.write_exports({"ledger": rows}, str(tmp_path / "out"))
    own = {n: sum(p.stat().st_size for p in (tmp_path / "out" / n).iterdir()) for n in ("ledger.csv", "ledger.json")}
    assert own["ledger.csv"] < 20_000 * 20 and own["ledger.json"] < 20_000 * 20
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out" / "ledger.csv"))
    assert back.subtract(rows).count() == 0 and back.count() == 20_000 == spark.read.json(str(tmp_path / "out" / "ledger.json")).count()


def test_text_lines(spark):
    lines = spark.createDataFrame([("d", 0, "07/01/2026 SHOP ONE $1,234.00"), ("d", 1, "07/01/2026  SHOP ONE $1,234.00"), ("d", 2, "07/02/26 BACK - ($2.25)"), ("d", 3, "hello 1.00")], "document_id string, line_no int, text string")
    got = sorted((r["raw_description"], float(r["amount"]), r["posted_date"]) for r in statements.parse_text_lines(lines).collect())
    assert got == [("BACK", -2.25, date(2026, 7, 2)), ("SHOP ONE", 1234.0, date(2026, 7, 1))]


def positioned(spark, lines, doc="d"):
    """Cells (x, text); words advance by their length."""
    rows = []
    for n, cells in enumerate(lines):
        for x, text in cells:
            for word in text.split():
                rows.append((doc, 1, word, float(x), 10.0 * n))
                x += len(word) * 5.8 + 4
    return spark.createDataFrame(rows, "document_id string, page int, text string, x0 double, top double")


def test_chase_words(spark):
    words = positioned(spark, [[(10, "CHASE PRIME VISA")], [(10, "ALEX EXAMPLE")], [(10, "Opening/Closing Date 06/05/26 - 07/04/26")], [(10, "Date"), (100, "Merchant Name"), (400, "$ Amount")], [(10, "PAYMENTS AND OTHER CREDITS")], [(10, "06/10"), (100, "Payment Thank You"), (395, "-1,049.15")], [(10, "PURCHASE")], [(10, "06/11"), (100, "AMAZON MKTP"), (395, "58.29")], [(10, "Order Number 111-222")]])
    lines = statements.words_to_lines(words)
    meta = statements.statement_metadata(lines)
    assert meta.select("issuer", "product", "cardholder").first() == ("Chase", "Amazon Prime Visa", "Alex Example")
    rows, errors = statements.parse_word_statements(lines, meta, "Chase")
    assert sorted((float(r["amount"]), r["raw_description"], r["posted_date"]) for r in rows.collect()) == [(-1049.15, "Payment Thank You", date(2026, 6, 10)), (58.29, "AMAZON MKTP Order Number 111-222", date(2026, 6, 11))]
    assert errors.count() == 0


def test_chase_headings_are_no_holders(spark):
    """Headings in capitals, also with each letter printed twice, words that run into the money column and dates off the cycle."""
    head = [[(10, "amazon | CHASE"), (250, "YOUR PRIME VISA POINTS")], [(10, "Opening/Closing Date"), (250, "12/08/25 - 01/08/26")], [(10, "AACCCCOOUUUNNTT SSUUMMMMAARRYY")], [(10, "ALEX EXAMPLE")]]
    body = [[(10, h)] for h in ("CASH ADVANCES", "BALANCE TRANSFERS", "IMPORTANT NEWS", "PURCHASE")] + [[(10, "Date"), (100, "Merchant Name"), (400, "$ Amount")]]
    body += [[(10, d), (100, n), (395, a)] for d, n, a in (("12/13", "DUMPLING SHOP", "36.86"), ("12/07", "EDGE CAFE", "6.50"), ("10/24", "FAR OFF", "1.00"), ("01/05", "BAKERY", "1,004.25"))]
    body[5].append((460, "WC2H"))
    words = positioned(spark, head + body).withColumn("text", statements.collapse_doubled_glyphs("text"))
    lines = statements.words_to_lines(words)
    meta = statements.statement_metadata(lines)
    assert meta.select("product", "holders").first() == ("Amazon Prime Visa", ["Alex Example"])
    rows, errors = statements.parse_word_statements(lines, meta, "Chase")
    assert sorted((r["raw_description"], float(r["amount"]), r["posted_date"], r["cardholder"]) for r in rows.collect()) == [
        ("BAKERY", 1004.25, date(2026, 1, 5), "Alex Example"), ("DUMPLING SHOP", 36.86, date(2025, 12, 13), "Alex Example"), ("EDGE CAFE", 6.5, date(2025, 12, 7), "Alex Example"),
    ] and errors.count() == 0
    two = statements.words_to_lines(positioned(spark, [*head[:2], [(10, "ALEX EXAMPLE")], [(10, "SAM EXAMPLE")], *body]))
    assert [r["error"] for r in statements.parse_word_statements(two, statements.statement_metadata(two), "Chase")[1].collect()] == ["more than one cardholder"]


def test_capital_one_words(spark):
    words = positioned(spark, [[(10, "Capital One Savor Credit Card | Mastercard ending in 1")], [(10, "Jun 5, 2026 - Jul 4, 2026 | 30 days in Billing Cycle")], [(10, "Alex Example: Payments, Credits and Adjustments")], [(10, "Trans Date"), (90, "Post Date"), (170, "Description"), (400, "Amount")], [(10, "Jun 10"), (90, "Jun 11"), (170, "PAYMENT"), (395, "$20.00")], [(10, "Sam Example: Transactions")], [(10, "Jun 12"), (90, "Jun 13"), (170, "SHOP"), (395, "$23.09")], [(10, "Total Transactions for This Period $23.09")], [(10, "Interest Charged")], [(10, "Interest Charge on Purchases $3.56")], [(10, "Interest Charge on Cash Advances $0.00")]])
    lines = statements.words_to_lines(words)
    rows, errors = statements.parse_word_statements(lines, statements.statement_metadata(lines), "Capital One")
    got = sorted((float(r["amount"]), r["raw_description"], r["posted_date"], r["section"]) for r in rows.collect())
    assert got == [(-20.0, "PAYMENT", date(2026, 6, 11), "payments"), (3.56, "Interest Charge on Purchases", date(2026, 7, 4), "interest"), (23.09, "SHOP", date(2026, 6, 13), "transactions")]
    assert {r["cardholder"] for r in rows.collect() if r["section"] == "transactions"} == {"Sam Example"} and errors.count() == 0
    declared = statements.declared_totals(lines)
    assert statements.validate_totals(rows, declared).count() == 0
    assert statements.validate_totals(rows.where("section <> 'transactions'"), declared).count() == 1


def test_ingest_of_extracted_words(spark, tmp_path):
    """PDF documents come in by their words; one whose rows miss its printed total, one without words and one that isn't its
    folder's issuer fail, and leave the others alone."""
    head = [[(10, "Capital One Savor Credit Card | Mastercard ending in 1")], [(10, "Jun 5, 2026 - Jul 4, 2026 | 30 days in Billing Cycle")], [(10, "Sam Example: Transactions")], [(10, "Trans Date"), (90, "Post Date"), (170, "Description"), (400, "Amount")], [(10, "Jun 12"), (90, "Jun 13"), (170, "SHOP"), (395, "$23.09")]]
    pages = {
        "cap/a.pdf": [*head, [(10, "Total Transactions for This Period $23.09")]], "cap/b.pdf": [*head, [(10, "Total Transactions for This Period $24.09")]],
        "other/c.pdf": [[(10, "07/01/2026 LUNCH $10.00")], [(10, "Thank you")]], "cap/d.pdf": [[(10, "Chase Sapphire")], [(10, "07/01/2026 LUNCH $10.00")]], "cap/e.pdf": None,
    }
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    write(inbox, {name.replace("cap/", "capitalone/"): name for name in pages})
    docs = documents.read_documents(spark, str(inbox))
    ids = {r["source_file"].split("/")[1]: r["document_id"] for r in docs.collect()}
    words = None
    for name, lines in pages.items():
        if lines:
            own = positioned(spark, lines, ids[name.split("/")[1]])
            words = own if words is None else words.unionByName(own)
    assert ingest(docs, out, words=words) == {"added": 2, "parsed": 2, "failed": 3}
    rows = {r["raw_description"]: (r["posted_date"], float(r["amount"]), r["card_issuer"], r["cardholder"]) for r in store.read_ledger(spark, f"{out}/ledger").collect()}
    assert rows == {"SHOP": (date(2026, 6, 13), 23.09, "Capital One", "Sam Example"), "LUNCH": (date(2026, 7, 1), 10.0, None, None)}
    errors = {r["source_file"].split("/")[1]: r["error"] for r in spark.read.parquet(f"{out}/manifest").where("status = 'failed'").collect()}
    assert errors == {"b.pdf": "rows don't add up to a printed total", "d.pdf": "no statement identity", "e.pdf": "no extractable text"}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_parsed")]
    assert ingest(docs, out, words=words)["failed"] == 3 and store.read_ledger(spark, f"{out}/ledger").count() == 2


def test_wells_fargo_words(spark):
    head = [[(10, "WELLS FARGO AUTOGRAPH VISA CARD")], [(10, "ALEX Q EXAMPLE")], [(10, "Statement Period 06/05/2026 to 07/04/2026")], [(10, "Trans"), (60, "Post"), (110, "Reference"), (200, "Description"), (400, "Credits"), (470, "Charges")]]
    body = [[(10, "Payments")], [(10, "06/10"), (60, "06/11"), (110, "REF1"), (200, "PAYMENT"), (400, "316.72")], [(10, "Purchases, Balance Transfers & Other Charges")], [(10, "06/12"), (60, "06/12"), (110, "REF2"), (200, "A LONG MERCHANT NAME THAT RUNS OVER"), (470, "13.99")]]
    lines = statements.words_to_lines(positioned(spark, head + body))
    rows, errors = statements.parse_word_statements(lines, statements.statement_metadata(lines), "Wells Fargo")
    assert sorted((float(r["amount"]), r["raw_description"]) for r in rows.collect()) == [(-316.72, "PAYMENT"), (13.99, "A LONG MERCHANT NAME THAT RUNS OVER")] and errors.count() == 0
    both = statements.words_to_lines(positioned(spark, [*head, [(10, "Payments")], [(10, "06/10"), (60, "06/11"), (110, "R"), (200, "X"), (400, "1.00"), (470, "2.00")]]))
    rows, errors = statements.parse_word_statements(both, statements.statement_metadata(both), "Wells Fargo")
    assert rows.count() == 0 and errors.count() == 1


def test_account_summary(spark):
    texts = ["Previous Balance $100.00", "Payments -$50.00", "Other Credits $0.00", "Transactions + $25.00", "Cash Advances + $0.00", "Fees Charged + $0.00", "Interest Charged + $1.00", "New Balance = $76.00"]
    lines = spark.createDataFrame([("good", i, t) for i, t in enumerate(texts)] + [("bad", i, t.replace("76", "77")) for i, t in enumerate(texts)] + [("some", 0, texts[0])], "document_id string, line_no int, text string")
    assert [r["document_id"] for r in statements.validate_account_summary(lines).collect()] == ["bad"]


def test_doubled_glyphs(spark):
    rows = spark.createDataFrame([("AACCCCOOUUNNTT",), ("ALEX",), (None,), ("BALLOON",)], "x string")
    assert [r[0] for r in rows.select(statements.collapse_doubled_glyphs("x")).collect()] == ["ACCOUNT", "ALEX", None, "BALLOON"]


def test_identity_detection(spark):
    products = spark.createDataFrame([("American Express", "Gold")], "issuer string, product string")
    docs = [
        ("a", "x.pdf", "pdf", "Welcome to American Express, paid at CHASE", "american express gold card", None), ("b", "x.pdf", "pdf", "CHASE sapphire preferred", "chase sapphire preferred", None),
        ("c", "amex-july.pdf", "pdf", "", "", None), ("d", "x.pdf", "pdf", "Wells Fargo and Capital One", "", None), ("e", "x.csv", "csv", None, None, ["Post Date", "Transaction Date", "Description", "Amount"]), ("f", "x.csv", "csv", None, None, ["a"]),
    ]
    got = {r["document_id"]: (r["issuer"], r["product"], r["confidence"]) for r in documents.detect_statement_identity(spark.createDataFrame(docs, "document_id string, source_file string, suffix string, header string, body string, columns array<string>"), products).collect()}
    assert got == {"a": ("American Express", "Gold", "detected"), "b": ("Chase", "Sapphire Preferred", "detected"), "c": ("American Express", None, "product_required"), "d": (None, None, "manual"), "e": ("Chase", None, "detected"), "f": (None, None, "manual")}
    keys = spark.createDataFrame([("Chase", "Visa"), ("Chase", "Sapphire Reserve")], "i string, p string").select(documents.card_key("i", "p")).collect()
    assert [r[0] for r in keys] == ["chase", "chase-sapphire-reserve"]


def test_dictionaries(spark):
    rows = dictionaries.dictionary_rows({
        "rules": {"categories": ["Food", "Fun"], "subcategories": {"Food": ["Coffee"], "Fun": []}, "rules": [{"match": {}, "category": "No"}, {"match": {"merchant_regex": "x"}, "category": "Food"}]},
        "merchants": {"merchants": [{"aliases": ["a"]}, {"canonical": "B", "aliases": ["b", {"exact": "C"}]}]}, "tags": {"tags": [{"id": "t", "kind": "odd"}]}, "card_products": {"products": {"Chase": ["A", " A ", "B"]}},
    })
    assert rows["rules"] == [(1, "regex", "x", "Food", "")] and [r[2:4] for r in rows["aliases"]] == [("regex", "b"), ("exact", "C")]
    assert rows["tags"] == [("t", "t", "other")] and rows["products"] == [("Chase", "A"), ("Chase", "B")] and rows["categories"] == [("Food", "Coffee"), ("Fun", None)]
