"""Column functions that read amounts and dates from statement text; null marks what can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

#: Date forms tried in order.
DATE_FORMATS = ("MM/dd/yyyy", "M/d/yyyy", "MM/dd/yy", "M/d/yy", "yyyy-MM-dd", "yyyy/MM/dd", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "d MMM yyyy", "MM-dd-yyyy")


def parse_amount(c: Column | str) -> Column:
    """Decimal with 2 places, halves rounded up: $ and , are dropped, (x) and x- are negative. Null if it is no number."""
    if isinstance(c, str):  # most amounts of a column are plain numbers
        return F.coalesce(F.when(F.col(c).rlike(r"^-?\d{1,15}\.\d{2}$"), F.col(c).try_cast("decimal(18,2)")), parse_amount(F.col(c)))
    text = strip(F.regexp_replace(col(c).cast("string"), r"[$,]", ""))
    negative = text.rlike(r"^\(.*\)$") | text.rlike(r"^[^-].*-$")
    core = strip(F.regexp_replace(text, r"^\(|\)$|-$", ""))
    plain = core.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(plain, F.expr("1")).cast("int") * core.try_cast("decimal(28,10)")
    value = value.try_cast("decimal(18,2)")
    return F.when(negative, -value).otherwise(value)


def parse_date(c: Column | str) -> Column:
    """The first of DATE_FORMATS that reads the text; null if none does."""
    if isinstance(c, str):  # most dates of a column have the first form
        return F.coalesce(F.when(F.col(c).rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(c, DATE_FORMATS[0])), parse_date(F.col(c)))
    text = strip(F.regexp_replace(col(c).cast("string"), r"[ T]\d{1,2}:\d{2}(:\d{2})?.*$", ""))
    shapes = {"MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "MM/dd/yy": r"^\d{2}/\d{2}/\d{2}$", "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$"}
    tries = [F.when(text.rlike(shapes[f]), F.try_to_date(text, f)) if f in shapes else F.try_to_date(text, f) for f in DATE_FORMATS]
    return F.coalesce(*tries)


def parse_month_day(c: Column | str) -> Column:
    """struct(month, day) of m/d (1-12, 1-31) or a month's name and a day that exists in a leap year; else null."""
    text = strip(col(c))
    month, day = (F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})$", i).try_cast("int") for i in (1, 2))
    numeric = F.when(month.between(1, 12) & day.between(1, 31), F.struct(month.alias("month"), day.alias("day")))
    short = F.initcap(F.regexp_replace(text, r"^([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2})$", "$1 $2"))
    named = F.try_to_date(F.concat(short, F.lit(" 2024")), "MMM d yyyy")
    return F.coalesce(numeric, F.when(named.isNotNull(), F.struct(F.month(named).alias("month"), F.dayofmonth(named).alias("day"))))


def resolve_cycle_date(month: Column, day: Column, start: Column, end: Column, grace_days: int = 1) -> Column:
    """The date of month and day in the only year that puts it inside the cycle; else the only one within the days of
    grace around it; else null."""
    years = F.sequence(F.year(start) - 1, F.year(end) + 1)
    dates = F.filter(F.transform(years, lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day))), lambda d: d.isNotNull())
    inside = F.filter(dates, lambda d: d.between(start, end))
    near = F.filter(dates, lambda d: d.between(F.date_sub(start, grace_days), F.date_add(end, grace_days)))
    return F.when(F.size(inside) == 1, F.element_at(inside, 1)).when(F.size(near) == 1, F.element_at(near, 1))
