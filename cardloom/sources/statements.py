"""Statements to raw transactions: CSV exports, text lines and positioned words; all or nothing for each document."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import parse_amount, parse_date, parse_month_day, resolve_cycle_date
from ..functions.text import col, squeeze, squeeze_column, strip, strip_column, title_if_upper
from .documents import few as _few

#: Headings that CSV exports give their columns.
ALIASES = {
    "date": ["posted date", "post date", "transaction date", "date", "trans date"],
    "description": ["description", "memo", "payee", "merchant", "name", "details"],
    "amount": ["amount", "amt", "transaction amount"],
}
MONEY = r"[+-]?\s*\$?\s*\d{1,3}(?:,\d{3})*\.\d{2}"


#: Data rows of a document that leave a Python worker at once.
CHUNK = 4096


def _csv_lines(content: pa.Buffer) -> Iterator[list[str]]:
    """The rows of a CSV document, as it is read on."""
    return csv.reader(io.TextIOWrapper(pa.BufferReader(content), "utf-8-sig", newline="\n"))


def _csv_chunks(content: pa.Buffer) -> Iterator[list[tuple[list[str], list[str]] | None]]:
    """Chunks of (headings, values) of each data row; one of None if the document can't be read. A document is read twice, as one
    fails as a whole and isn't held as rows."""
    try:
        head = [h.strip() for h in next(_csv_lines(content), [])]
        for _ in _csv_lines(content):
            pass
    except (UnicodeDecodeError, csv.Error):
        head = []
    if not head:
        yield [None]
        return
    rows = _csv_lines(content)
    next(rows)
    repeated = len(set(head)) < len(head)
    chunk = []
    for r in rows:
        if any(x.strip() for x in r):
            if repeated:
                cells = dict(zip(head, r))
                chunk.append((list(cells), list(cells.values())))
            else:
                chunk.append((head[: len(r)], r[: len(head)]))
            if len(chunk) == CHUNK:
                yield chunk
                chunk = []
    if chunk:
        yield chunk


def csv_cells(docs: DataFrame, *also: str) -> DataFrame:
    """(document_id, source_row, cells) and the document's columns `also`: each data row of a CSV document as a map from heading to
    text. A document that isn't UTF-8 gives one row without cells."""
    held = docs.select("document_id", *also, "content")
    ddl = ", ".join(f"`{c}` {t}" for c, t in held.dtypes if c != "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "content"]
            for i in range(batch.num_rows):
                own, at = [batch.column(n)[i] for n in names], 0
                content = batch.column("content")[i].as_buffer()
                for chunk in _csv_chunks(content if content is not None else pa.py_buffer(b"")):
                    offsets, n = [0], 0
                    for r in chunk:
                        n += len(r[0]) if r else 0
                        offsets.append(n)
                    if chunk[0] is None:
                        cells = pa.nulls(1, pa.map_(pa.string(), pa.string()))
                    else:
                        keys, values = (pa.array([x for r in chunk for x in r[k]], pa.string()) for k in (0, 1))
                        cells = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), keys, values)
                    columns = [pa.array([v.as_py()] * len(chunk), v.type) for v in own]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(range(at, at + len(chunk)), pa.int64()), cells], [*names, "source_row", "cells"])
                    at += len(chunk)

    return held.mapInArrow(run, f"{ddl}, source_row bigint, cells map<string,string>")


def _cell(*names: str) -> Column:
    return F.coalesce(*[F.try_element_at("cells", F.lit(n)) for n in names])


def _alias(kind: str) -> Column:
    """The first column, in the file's order, whose heading is an alias."""
    keys = F.filter(F.map_keys("cells"), lambda k: F.lower(F.trim(k)).isin(ALIASES[kind] if kind in ALIASES else [kind]))
    return F.try_element_at("cells", F.try_element_at(keys, F.lit(1)))


def parse_csv_statements(docs: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw transactions and (document_id, status, row_count, error). docs is routed and has card, card_issuer and
    card_product; rows without description are skipped, any other bad row fails its whole document, the others go on.

    `keep` writes a table and reads it back: documents are then parsed once, though both results need the rows."""
    todo = docs.where("status is null and suffix = 'csv'")
    rows = csv_cells(todo, "parser", "card", "card_issuer", "card_product", "source_file")
    p = F.col("parser")
    chase_amount = parse_amount("_amount")
    back = F.lower(F.coalesce(_cell("Type"), F.lit(""))).isin("payment", "return", "adjustment")
    chase = F.when(chase_amount < 0, F.abs(chase_amount)).when(back, -F.abs(chase_amount)).otherwise(chase_amount)
    # Looked up once a row: what is used several times is a column first.
    own = p.isin("chase", "amex")
    rows = rows.withColumns({
        "_description": F.when(p == "generic", _alias("description")).otherwise(_cell("Description")),
        "_date": F.when(p == "chase", _cell("Post Date", "Transaction Date")).when(p == "amex", _cell("Date")).otherwise(_alias("date")),
        "_amount": F.when(own, _cell("Amount")).otherwise(_alias("amount")), "_debit": F.when(~own, _alias("debit")), "_credit": F.when(~own, _alias("credit")),
        "_two": F.exists(F.map_keys("cells"), lambda k: F.lower(F.trim(k)).isin("debit", "credit")),
    })
    rows = rows.withColumns({f"_{k}": F.when(strip_column(f"_{k}") != "", F.col(f"_{k}")) for k in ("debit", "credit")})
    debit_text, credit_text, two = F.col("_debit"), F.col("_credit"), F.col("_two")
    debit, credit = F.abs(parse_amount("_debit")), -F.abs(parse_amount("_credit"))
    either = debit_text.isNotNull() != credit_text.isNotNull()
    generic = F.when(two, F.when(either, F.coalesce(debit, credit))).otherwise(parse_amount("_amount"))
    parsed = rows.withColumns({
        "raw_description": strip_column("_description"),
        "posted_date": parse_date("_date"),
        "amount": F.when(p == "chase", chase).when(p == "amex", parse_amount("_amount")).otherwise(generic),
        "cardholder": F.when(p == "amex", title_if_upper(F.coalesce(_cell("Card Member"), F.lit("")))),
    })
    unready = (p == "amex") & ((F.coalesce("card_issuer", F.lit("")) != "American Express") | (F.coalesce("card_product", F.lit("")) == ""))
    heading = F.when(p == "generic", F.exists(F.map_keys("cells"), lambda k: F.lower(F.trim(k)).isin(ALIASES["description"]))).otherwise(F.map_contains_key("cells", "Description"))
    skip = F.coalesce(F.col("raw_description"), F.lit("")) == ""
    problem = F.when(F.col("cells").isNull(), "unreadable file").when(unready, "issuer and product must be selected").when(~heading, "no description column").when(skip, None).when(F.col("posted_date").isNull(), "bad date").when(F.col("amount").isNull(), "bad amount")
    parsed = parsed.withColumns({"_problem": problem, "_skip": skip}).drop("cells", "_debit", "_credit", "_amount", "_description", "_date", "_two")
    parsed = keep(parsed) if keep else parsed
    ends = parsed.groupBy("document_id").agg(F.max("_problem").alias("_bad"), F.count_if(~F.col("_skip")).alias("n"))
    status = todo.select("document_id").distinct().join(ends, "document_id", "left").select(
        "document_id", F.when(F.col("_bad").isNull(), "parsed").otherwise("failed").alias("status"), F.when(F.col("_bad").isNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("row_count"), F.col("_bad").alias("error")
    )
    status = keep(status) if keep else status
    failed = status.where("status = 'failed'").select("document_id")
    failed = F.broadcast(failed) if keep and _few(failed) else failed
    good = parsed.where("not _skip").join(failed, "document_id", "left_anti")
    issuer = F.when(p == "chase", F.coalesce("card_issuer", F.lit("Chase"))).otherwise(F.col("card_issuer"))
    return good.select("posted_date", "amount", "raw_description", "card", issuer.alias("card_issuer"), "card_product", "cardholder", "source_file", F.col("document_id").alias("source_document_id"), "source_row"), status


def parse_text_lines(lines: DataFrame) -> DataFrame:
    """(document_id, posted_date, amount, raw_description, source_row) of lines (document_id, line_no, text) that read as
    date, description and amount; equal rows of a document count once."""
    text = squeeze("text")
    rest = F.regexp_extract(text, r"^\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\s+(.+)$", 1)
    amount = F.regexp_extract(rest, r"(-?\$?\d{1,3}(?:,\d{3})*\.\d{2}|\(\$?\d{1,3}(?:,\d{3})*\.\d{2}\))\s*$", 1)
    rows = lines.select(
        "document_id", "line_no", F.regexp_extract(text, r"^(\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?)\s", 1).alias("date_text"), parse_amount(amount).alias("amount"),
        F.regexp_replace(F.regexp_replace(rest, r"(-?\$?\d{1,3}(?:,\d{3})*\.\d{2}|\(\$?\d{1,3}(?:,\d{3})*\.\d{2}\))\s*$", ""), r"^[ \-]+|[ \-]+$", "").alias("raw_description"),
    ).where((F.col("date_text") != "") & F.col("amount").isNotNull() & (F.col("raw_description") != ""))
    once = rows.groupBy("document_id", "date_text", "amount", "raw_description").agg(F.min("line_no").alias("source_row"))
    return once.select("document_id", parse_date(F.regexp_replace("date_text", "-", "/")).alias("posted_date"), "amount", "raw_description", "source_row")


def collapse_doubled_glyphs(c: Column | str) -> Column:
    """Letters printed twice are halved, where at least 35 % of neighbouring letters are equal (of 4 letters or more)."""
    text = col(c)
    letters = F.lower(F.regexp_replace(text, r"[^\p{L}]", ""))
    equal = F.length(letters) - F.length(F.regexp_replace(letters, r"(.)\1+", "$1"))
    doubled = (F.length(letters) >= 4) & (equal >= 0.35 * (F.length(letters) - 1))
    # Of a run of an odd length the last letter goes with the pair before it.
    return F.when(doubled, F.regexp_replace(text, r"(?iu)(\p{L})\1(?:\1(?!\1))?", "$1")).otherwise(text)


def words_to_lines(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """(document_id, page, line_no, words array<struct<text,x0>>, text): words by height; one joins the line if it is within
    the tolerance of the line's first word."""

    # Heights that can't be read stand last on a page and never begin a line of their own, unless there is no other.
    real = words.where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")).select("document_id", "page", F.coalesce(F.col("top").cast("double"), F.lit(float("nan"))).alias("top"), F.struct(F.when(~F.isnan("x0"), F.col("x0")).cast("double").alias("x0"), "text").alias("w"))
    heights = real.groupBy("document_id", "page", "top").agg(F.collect_list("w").alias("words"))
    pages = heights.groupBy("document_id", "page").agg(F.sort_array(F.collect_list(F.struct("top", "words"))).alias("at"))

    def step(done: Column, top: Column) -> Column:
        begins = (F.size(done) == 0) | (~F.isnan(top) & (top - F.try_element_at(done, F.lit(-1)) > tolerance))
        return F.concat(done, F.array(F.when(begins, top).otherwise(F.try_element_at(done, F.lit(-1)))))

    pages = pages.withColumn("_bases", F.aggregate(F.col("at")["top"], F.array().cast("array<double>"), step))
    pages = pages.withColumn("_starts", F.array_distinct("_bases"))
    joined = F.transform("_starts", lambda b: F.flatten(F.transform(F.filter(F.arrays_zip(F.col("at")["words"].alias("words"), F.col("_bases").alias("base")), lambda z: z["base"] == b), lambda z: z["words"])))
    pages = pages.select("document_id", "page", F.when(F.size("_starts") == F.size("at"), F.col("at")["words"]).otherwise(joined).alias("_lines"))
    ordered = pages.select("document_id", F.col("page").cast("int").alias("page"), F.posexplode("_lines").alias("line", "words")).withColumn("words", F.sort_array("words"))
    text = F.array_join(F.col("words")["text"], " ")
    number = F.row_number().over(W.partitionBy("document_id").orderBy("page", "line")) - 1
    return ordered.select("document_id", "page", number.alias("line_no"), "words", text.alias("text"))


#: The headings of each issuer's table of activity, in the order of its columns.
COLUMNS = {"Chase": ["date", "merchant", "amount"], "Capital One": ["trans", "post", "description", "amount"], "Wells Fargo": ["trans", "post", "reference", "description", "credits", "charges"]}
#: Headings of sections and what their rows are; `none` ends activity.
SECTIONS = {
    "Chase": {
        "payments and other credits": "payments", "purchase": "purchases", "purchases": "purchases", "fees charged": "fees", "interest charged": "interest", "cash advances": "cash_advances",
        "purchases and redemptions": "none", "interest charges": "none", "rewards activity": "none", "account activity": "none", "account activity continued": "none", "account summary": "none",
    },
    "Capital One": {"payments, credits and adjustments": "payments", "transactions": "transactions", "fees": "fees", "interest charged": "interest", "cash advances": "cash_advances"},
    "Wells Fargo": {"payments": "payments", "other credits": "credits", "purchases, balance transfers & other charges": "purchases", "fees charged": "fees", "interest charged": "interest"},
}
#: Words in capitals of each issuer's statements that are no part of a name.
NOT_NAMES = {
    "Chase": [
        "ACCOUNT", "ACTIVITY", "ADVANCES", "AMAZON", "BALANCE", "CASH", "CHASE", "CARDMEMBER", "CREDITS", "FEES", "IMPORTANT", "INTEREST", "MESSAGES", "NEWS", "ORDER",
        "PAYMENTS", "POINTS", "PRIME", "PURCHASE", "PURCHASES", "REWARDS", "SERVICE", "SHOP", "SUMMARY", "TRANSFERS", "VISA", "YOUR",
    ],
    "Wells Fargo": [
        "ACCOUNT", "AMOUNT", "AUTOGRAPH", "BALANCE", "CARD", "CHARGED", "CHARGES", "CREDITS", "FARGO", "FEES", "INTEREST", "PAYMENTS", "PURCHASES", "SIGNATURE",
        "TRANSACTIONS", "VISA", "WELLS",
    ],
}


def _holder(text: Column, issuer: str) -> Column:
    """A line of two to four words in capitals as a name, if none of them is a word of the issuer's statements or the line is one of
    its headings; null otherwise. Wells Fargo prints middle initials, which go."""
    words, least = F.split(text, " "), "*" if issuer == "Wells Fargo" else "+"
    named = text.rlike(rf"^[A-Z][A-Z'\-]{least}( [A-Z][A-Z'\-]{least}){{1,3}}$") & ~F.arrays_overlap(words, F.array(*map(F.lit, NOT_NAMES[issuer]))) & ~F.lower(text).isin(list(SECTIONS[issuer]))
    name = title_if_upper(text)
    return F.when(named, F.regexp_replace(name, r"^(\S+) \S (\S+)$", "$1 $2") if issuer == "Wells Fargo" else name)


def statement_metadata(lines: DataFrame) -> DataFrame:
    """(document_id, issuer, product, cycle_start, cycle_end, cardholder, holders) from the lines (document_id, line_no, text)
    of statements. Holders are found by the issuer's own rules; Capital One names them with its sections instead."""
    # Each step is a column before the next uses it: texts are squeezed once, and dates are read only where a period stands.
    lines = lines.select("document_id", "line_no", squeeze_column("text").alias("_text"))
    lines = lines.withColumn("_low", F.lower("_text"))
    text, low = F.col("_text"), F.col("_low")
    issuer = F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in ("Capital One", "Wells Fargo", "Chase")])
    capital, wells = F.regexp_extract(text, r"([A-Za-z0-9 ]+?)\s+Credit Card\s*\|", 1), F.regexp_extract(text, r"(?i)WELLS FARGO\s+(.+?)\s+CARD", 1)
    prime = F.contains(low, F.lit("prime visa")) | (F.contains(low, F.lit("amazon")) & F.contains(low, F.lit("chase")))
    chase = F.when(prime, "Amazon Prime Visa").when(F.contains(low, F.lit("sapphire reserve")), "Sapphire Reserve").when(F.contains(low, F.lit("sapphire preferred")), "Sapphire Preferred").when(F.contains(low, F.lit("sapphire")), "Sapphire")
    found = {k: F.col(f"_{k}") for k in ("capital", "wells")}
    product = F.coalesce(F.when(found["capital"] != "", title_if_upper(F.regexp_replace(squeeze(found["capital"]), "(?i)^capital one ", ""))), F.when(found["wells"] != "", F.initcap(F.regexp_replace(found["wells"], "®", ""))), chase)
    dates = r"(\d{1,2}/\d{1,2}/\d{2,4}|[A-Z][a-z]{2}\s+\d{1,2},\s+\d{4})\s*(?:-|–|to)\s*(\d{1,2}/\d{1,2}/\d{2,4}|[A-Z][a-z]{2}\s+\d{1,2},\s+\d{4})"
    period = F.when(text.rlike(dates), F.struct(*[squeeze(F.regexp_extract(text, dates, i)).alias(k) for i, k in ((1, "start"), (2, "end"))]))
    card = F.contains(low, F.lit("card"))
    lines = lines.withColumns({"_capital": F.when(card, capital), "_wells": F.when(card, wells), "_period": period, "_issuer": issuer})
    lines = lines.withColumns({"_start": F.col("_period.start"), "_end": F.col("_period.end")}).withColumns({"_product": product, **{f"_{k}_date": F.when(F.col("_period").isNotNull(), parse_date(f"_{k}")) for k in ("start", "end")}, **{f"_{n}": _holder(text, n) for n in NOT_NAMES}})
    first = lambda c, k: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(k)
    names = {n: F.array_sort(F.collect_set(f"_{n}")).alias(f"_{n}") for n in NOT_NAMES}
    out = lines.groupBy("document_id").agg(first("_issuer", "issuer"), first("_product", "product"), first("_start_date", "cycle_start"), first("_end_date", "cycle_end"), *names.values())
    holders = F.coalesce(*[F.when(F.col("issuer") == n, F.col(f"_{n}")) for n in NOT_NAMES], F.array().cast("array<string>"))
    out = out.withColumn("holders", holders).drop(*[f"_{n}" for n in NOT_NAMES])
    return out.withColumn("cardholder", F.when(F.size("holders") == 1, F.col("holders")[0]))


def _position(heading: str) -> Column:
    hits = F.filter("words", lambda w: F.regexp_replace(F.lower(w["text"]), ":$", "") == heading)
    return F.try_element_at(hits, F.lit(1))["x0"]


def parse_word_statements(lines: DataFrame, metadata: DataFrame, issuer: str) -> tuple[DataFrame, DataFrame]:
    """Raw rows and (document_id, error) of the issuer's statements, from lines with positioned words.

    The table's heading gives the columns' places, section headings what rows mean; both hold until the next. Signs: Chase
    as printed; Capital One payments negative, fees, interest and cash advances positive; Wells Fargo by column, where text
    that runs over into the money columns returns to the description and a row with both amounts fails the document. A
    Chase line "Order Number ..." belongs to the row before it; Capital One interest lines are dated at the cycle's end."""
    heads, flow = COLUMNS[issuer], W.partitionBy("document_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = lines.join(metadata.where(F.col("issuer") == issuer), "document_id")
    rows = rows.withColumn("_clean", squeeze_column("text")).withColumn("_low", F.lower("_clean"))
    low = F.col("_low")
    places = [F.coalesce(_position("$"), _position(h)) if (issuer, h) == ("Chase", "amount") else F.coalesce(_position(h), _position("transaction")) if (issuer, h) == ("Chase", "date") else _position(h) for h in heads]
    # Places are looked for in lines that hold all headings at all.
    spoken = F.lit(True)
    for h in heads:
        here = F.contains(low, F.lit(h))
        spoken = spoken & (here | F.contains(low, F.lit({"amount": "$", "date": "transaction"}[h])) if issuer == "Chase" and h != "merchant" else here)
    rows = rows.withColumn("_spoken", spoken)
    rows = rows.withColumns({f"_p{i}": F.when(F.col("_spoken"), p) for i, p in enumerate(places)})
    rising = F.lit(True)
    for i in range(len(heads) - 1):
        rising = rising & F.coalesce(F.col(f"_p{i}") < F.col(f"_p{i + 1}"), F.lit(False))
    last_money = issuer != "Wells Fargo"
    edges = [(F.col(f"_p{i + 1}") - 8) if last_money and i == len(heads) - 2 else (F.col(f"_p{i}") + F.col(f"_p{i + 1}")) / 2 for i in range(len(heads) - 1)]
    names = SECTIONS[issuer]
    if issuer == "Capital One":
        total = F.contains(low, F.lit("total ")) | low.startswith("totals ")
        label = F.when(~total, F.coalesce(*[F.when(low.endswith(k), F.lit(k)) for k in names]))
        owner = squeeze(F.regexp_replace(F.expr("substring(_clean, 1, length(_clean) - length(_label))"), r"^[ :\-]+|[ :\-]+$", ""))
    else:
        label, owner = F.when(low.isin(list(names)), low), None
    section_of = F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("_label"))
    rows = rows.withColumns({"_label": label, "_header": rising}).withColumn("_edges", F.when(F.col("_header"), F.array(*edges)))
    if owner is not None:
        rows = rows.withColumn("_owner", F.when(owner.rlike(r"^[A-Za-z][A-Za-z .'\-]{1,80}$"), title_if_upper(owner)))
    else:
        rows = rows.withColumn("_owner", F.col("cardholder"))
    rows = rows.withColumns({"section": F.last(section_of, ignorenulls=True).over(flow), "_at": F.last("_edges", ignorenulls=True).over(flow), "_holder": F.last(F.when(F.col("_label").isNotNull(), F.struct("_owner")), ignorenulls=True).over(flow)["_owner"] if owner is not None else F.col("_owner")})

    def cell(i: int) -> Column:
        inside = F.filter("words", lambda w: ((w["x0"] >= F.col("_at")[i - 1]) if i else F.lit(True)) & ((w["x0"] < F.col("_at")[i]) if i < len(heads) - 1 else F.lit(True)))
        return squeeze(F.array_join(F.transform(inside, lambda w: w["text"]), " "))

    money = lambda c: parse_amount(F.regexp_replace(F.try_element_at(F.regexp_extract_all(c, F.lit(f"({MONEY})"), 1), F.lit(-1)), r"\s", ""))
    rows = rows.withColumns({f"_c{i}": cell(i) for i in range(len(heads))})
    when = F.col("_c0") if issuer == "Chase" else F.col("_c1")
    # Read once a line, and used several times.
    rows = rows.withColumn("_day", parse_month_day(when)).withColumns({f"_m{i}": money(f"_c{i}") for i in range(len(heads)) if heads[i] in ("amount", "credits", "charges")})
    month_day = F.col("_day")
    posted = resolve_cycle_date(month_day["month"], month_day["day"], F.col("cycle_start"), F.col("cycle_end"))
    live = ~F.col("_header") & F.col("_label").isNull() & F.col("_at").isNotNull() & F.coalesce(F.col("section") != "none", F.lit(False))
    both = F.lit(False)
    if issuer == "Chase":
        amount, description = F.col("_m2"), F.col("_c1")
    elif issuer == "Capital One":
        printed = F.col("_m3")
        amount = F.when(F.col("section") == "payments", -F.abs(printed)).when(F.col("section").isin("fees", "interest", "cash_advances"), F.abs(printed)).otherwise(printed)
        description = F.col("_c2")
        interest = F.lower("_clean").startswith("interest charge on ") & (F.abs(F.coalesce(money("_clean"), F.lit(0))) > 0)
        amount = F.when(interest, F.abs(money("_clean"))).otherwise(amount)
        description = F.when(interest, strip(F.regexp_replace(F.regexp_replace("_clean", MONEY, ""), r"[ \-]+$", ""))).otherwise(description)
        posted = F.when(interest, F.col("cycle_end")).when(parse_month_day("_c0").isNotNull(), posted)
        live = live | interest
    else:
        credit, charge = -F.abs("_m4"), F.abs("_m5")
        both = credit.isNotNull() & charge.isNotNull() & month_day.isNotNull()
        over = squeeze(F.regexp_replace(F.concat_ws(" ", "_c4", "_c5"), f"(^|\\s){MONEY}(?=\\s|$)", " "))
        amount, description = F.coalesce(credit, charge), squeeze(F.concat_ws(" ", "_c3", over))
        posted = F.when(F.size(F.regexp_extract_all("_c0", F.lit(r"(\b\d{2}/\d{2}\b)"), 1)) == 1, posted)
    rows = rows.withColumns({"posted_date": F.when(live, posted), "amount": F.when(live, amount), "raw_description": F.when(live, description), "_both": live & both})
    rows = rows.withColumn("_is", F.col("posted_date").isNotNull() & F.col("amount").isNotNull() & (F.coalesce("raw_description", F.lit("")) != ""))
    order = F.lower("_clean").startswith("order number ") & live & F.lit(issuer == "Chase")
    rows = rows.withColumns({"_n": F.sum(F.col("_is").cast("int")).over(flow), "_more": F.when(order & ~F.col("_is"), F.col("_clean"))})
    errors = rows.groupBy("document_id").agg(F.when(F.max("_both"), "a row has both a credit and a charge").when(F.lit(issuer != "Capital One") & (F.size(F.first("holders")) > 1), "more than one cardholder").when(F.first("product").isNull(), "no product").when(F.first("cycle_start").isNull(), "no statement period").alias("error"))
    whole = rows.where((F.col("_is") | F.col("_more").isNotNull()) & (F.col("_n") > 0)).groupBy("document_id", "_n").agg(
        *[F.first(F.when(F.col("_is"), F.col(c)), ignorenulls=True).alias(c) for c in ("posted_date", "amount", "section", "line_no", "issuer", "product", "_holder")],
        F.first(F.when(F.col("_is"), F.col("raw_description")), ignorenulls=True).alias("_d"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_more").isNotNull(), F.struct("line_no", "_more")))), lambda m: m["_more"]), " ").alias("_tail"),
    )
    good = whole.join(errors.where("error is not null").select("document_id"), "document_id", "left_anti")
    return good.select("document_id", "posted_date", "amount", squeeze(F.concat_ws(" ", "_d", "_tail")).alias("raw_description"), F.col("issuer").alias("card_issuer"), F.col("product").alias("card_product"), F.col("_holder").alias("cardholder"), "section", F.col("line_no").alias("source_row")), errors.where("error is not null")


#: Parsers of statements whose words stand in columns; words of other documents are read as plain lines.
WORD_ISSUERS = {"chase": "Chase", "capital_one": "Capital One", "wells_fargo": "Wells Fargo"}


def parse_page_statements(docs: DataFrame, words: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """parse_csv_statements for PDF documents, from their words (document_id, page, text, x0, top), however extracted.

    A document without words fails, and so does one of an issuer's whose identity, period or product isn't found, that has no
    rows, or (Capital One) whose rows and balances don't add up to what it prints; the others go on. `keep` writes a table and
    reads it back: lines, their metadata and each issuer's rows are used several times."""
    todo = docs.where("status is null and suffix = 'pdf'").select("document_id", "parser", "card", "source_file", F.col("card_issuer").alias("_issuer"), F.col("card_product").alias("_product"))
    own = words.join(todo.select("document_id", "parser"), "document_id")
    # Some of Chase's files give each letter twice.
    text = F.when(F.col("parser") == "chase", collapse_doubled_glyphs("text")).otherwise(F.col("text"))
    lines = keep(words_to_lines(own.withColumn("text", text)))
    routed = todo.select("document_id", "parser")
    found = keep(statement_metadata(lines).join(routed, "document_id"))
    plain = keep(parse_text_lines(lines.join(routed.where(~F.col("parser").isin(*WORD_ISSUERS)), "document_id", "left_semi")))
    rows = plain.withColumns({c: F.lit(None).cast("string") for c in ("card_issuer", "card_product", "cardholder")})
    bad = plain.where("posted_date is null").select("document_id", F.lit("bad date").alias("error"))
    for parser, issuer in WORD_ISSUERS.items():
        own = found.where(F.col("parser") == parser)
        if own.isEmpty():
            continue
        part, wrong = map(keep, parse_word_statements(lines, own, issuer))
        bad = bad.unionByName(wrong).unionByName(own.where(~F.coalesce(F.col("issuer") == issuer, F.lit(False))).select("document_id", F.lit("no statement identity").alias("error")))
        if issuer == "Capital One":
            printed = lines.join(own.select("document_id"), "document_id", "left_semi")
            for check, message in ((validate_totals(part, declared_totals(printed)), "rows don't add up to a printed total"), (validate_account_summary(printed), "balances don't add up")):
                bad = bad.unionByName(check.select("document_id", F.lit(message).alias("error")))
        rows = rows.unionByName(part.drop("section"))
    counts = rows.groupBy("document_id").agg(F.count("*").alias("n"))
    seen = lines.select("document_id").distinct().withColumn("_text", F.lit(True))
    ends = todo.join(bad.groupBy("document_id").agg(F.min("error").alias("_bad")), "document_id", "left").join(counts, "document_id", "left").join(seen, "document_id", "left")
    empty = F.col("parser").isin(*WORD_ISSUERS) & F.col("n").isNull()
    error = F.when(F.col("_text").isNull(), "no extractable text").otherwise(F.coalesce("_bad", F.when(empty, "no activity rows")))
    status = ends.withColumn("error", error).select(
        "document_id", F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("status"), F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("row_count"), "error"
    )
    good = rows.join(status.where("status = 'parsed'").select("document_id"), "document_id", "left_semi").join(todo, "document_id")
    return good.select(
        "posted_date", "amount", "raw_description", "card", F.coalesce("_issuer", "card_issuer").alias("card_issuer"), F.coalesce("_product", "card_product").alias("card_product"), "cardholder", "source_file",
        F.col("document_id").alias("source_document_id"), F.col("source_row").cast("bigint").alias("source_row"),
    ), status


def validate_totals(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """(document_id, section, extracted, declared) where a section's rows and its printed total differ by over 0.01."""
    sums = rows.groupBy("document_id", "section").agg(F.sum("amount").alias("extracted"))
    return declared.join(sums, ["document_id", "section"], "left").withColumn("extracted", F.coalesce("extracted", F.lit(0)).cast("decimal(28,2)")).where("abs(extracted - declared) > 0.01")


def declared_totals(lines: DataFrame) -> DataFrame:
    """(document_id, section, declared) from lines that begin "Total transactions", fees, interest or cash advances."""
    low = F.lower(squeeze("text"))
    names = {"total transactions": "transactions", "total fees": "fees", "total interest": "interest", "total cash advances": "cash_advances"}
    section = F.coalesce(*[F.when(low.startswith(k), F.lit(v)) for k, v in names.items()])
    amount = parse_amount(F.regexp_replace(F.try_element_at(F.regexp_extract_all("text", F.lit(f"({MONEY})"), 1), F.lit(-1)), r"\s", ""))
    rows = lines.select("document_id", "line_no", section.alias("section"), amount.alias("declared")).where("section is not null and declared is not null")
    return rows.groupBy("document_id", "section").agg(F.max_by("declared", "line_no").alias("declared"))


def validate_account_summary(lines: DataFrame) -> DataFrame:
    """(document_id, calculated, new_balance) of statements whose balances don't add up to 0.01; only those that print all
    eight values are judged."""
    names = {"previous balance": "previous_balance", "payments": "payments", "other credits": "other_credits", "transactions": "transactions", "cash advances": "cash_advances", "fees charged": "fees", "interest charged": "interest", "new balance": "new_balance"}
    low = F.lower(squeeze("text"))
    label = F.coalesce(*[F.when(low.startswith(k), F.lit(v)) for k, v in names.items()])
    amount = parse_amount(F.regexp_replace(F.try_element_at(F.regexp_extract_all("text", F.lit(f"({MONEY})"), 1), F.lit(-1)), r"\s", ""))
    rows = lines.select("document_id", "line_no", label.alias("label"), amount.alias("amount")).where("label is not null and amount is not null")
    wide = rows.groupBy("document_id").agg(*[F.max_by(F.when(F.col("label") == v, F.col("amount")), F.when(F.col("label") == v, F.col("line_no"))).alias(v) for v in names.values()]).na.drop()
    total = sum((F.col(v) for v in list(names.values())[1:-1]), F.col("previous_balance"))
    return wide.select("document_id", total.alias("calculated"), "new_balance").where("abs(calculated - new_balance) > 0.01")
