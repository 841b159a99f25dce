"""Dates of work records: year-month texts and integer month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of month names; words that mark an open end.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
CURRENT = ("present", "hiện tại", "now", "current", "đang làm", "đến nay")


#: How a date is read: numbers, words, and what stands between them.
_PIECES = r"[0-9]+|\p{L}+|[^0-9\p{L}]+"


def normalize_date(value: Column) -> Column:
    """YYYY-MM or YYYY out of free text, or null.

    The text is cut into numbers, words and separators, and four readings look at three pieces in a row: a year, a dash and
    a month; the same with a slash or dash; a month, a slash and a year; a month's name and a year. Each takes the first
    place that has its shape, and a reading whose month is impossible leaves the text to the next one. A lone year comes last.
    """
    s = F.translate(F.regexp_replace(F.lower(F.trim(value)), "tháng", "thang"), ".", "/")
    t = F.regexp_extract_all(s, F.lit(_PIECES), F.lit(0))
    n, end = F.size(t), F.array(F.lit(""))
    rows = F.arrays_zip(F.concat(end, t).alias("before"), t.alias("a"), F.concat(F.slice(t, 2, n), end).alias("sep"), F.concat(F.slice(t, 3, n), end, end).alias("b"))
    is_year, is_month = lambda x: x.rlike("^[0-9]{4}$"), lambda x: x.rlike("^[0-9]{1,2}$")
    names = F.array(*[F.lit(m) for m in MONTHS])

    def reading(shape, year: str, month) -> Column:
        at = F.get(F.filter(rows, shape), 0)
        n = month(at)
        return F.when(n.between(1, 12), F.concat(at[year], F.lit("-"), F.lpad(n.cast("string"), 2, "0")))

    year_first = lambda sep: lambda r: is_year(r["a"]) & r["sep"].rlike(sep) & is_month(r["b"])
    month_first = lambda r: is_month(r["a"]) & r["sep"].rlike(r"^/\s*$") & is_year(r["b"])
    named = lambda r: r["a"].rlike("^[a-z]{3,9}$") & r["sep"].rlike(r"^,?\s+$") & is_year(r["b"])
    alone = lambda r: r["a"].rlike("^(19|20)[0-9]{2}$") & ~r["before"].endswith("/") & ~r["sep"].rlike(r"^[\p{L}_]")
    return F.coalesce(
        reading(year_first(r"^\s*-\s*$"), "a", lambda r: r["b"].cast("int")),
        reading(year_first(r"^\s*[/-]\s*$"), "a", lambda r: r["b"].cast("int")),
        reading(month_first, "b", lambda r: r["a"].cast("int")),
        reading(named, "b", lambda r: F.array_position(names, F.left(r["a"], F.lit(3))).cast("int")),
        F.get(F.filter(rows, alone), 0)["a"],
    )


def is_current(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*CURRENT), F.lit(False))


def year_month(value: Column) -> Column:
    """struct(year, month) of a text that begins with YYYY or YYYY-MM; month 1 by default, an impossible month is null."""
    y = F.regexp_extract(value, r"^\s*(\d{4})", 1)
    m = F.regexp_extract(value, r"^\s*\d{4}-(\d{1,2})", 1)
    month = F.when(m == "", 1).otherwise(m.cast("int"))
    return F.when((y != "") & month.between(1, 12), F.struct(y.cast("int").alias("year"), month.alias("month")))


def months_between(start: Column, end: Column) -> Column:
    """Whole months from one year-month struct to another, null unless positive."""
    n = (end["year"] - start["year"]) * 12 + (end["month"] - start["month"])
    return F.when(n > 0, n)


def experience_years(items: Column, now: str) -> Column:
    """Years, two digits, over array<struct<start_date,end_date,is_current>>; null where no item has a positive span.
    ``now`` (YYYY-MM) stands for an open end, so that results repeat."""

    def span(x: Column) -> Column:
        open_ = F.coalesce(x["is_current"], F.lit(False)) | is_current(x["end_date"]) | x["end_date"].isNull()
        return months_between(year_month(x["start_date"]), F.when(open_, year_month(F.lit(now))).otherwise(year_month(x["end_date"])))

    months = F.filter(F.transform(items, span), lambda m: m.isNotNull())
    return F.when(F.size(months) > 0, F.round(F.aggregate(months, F.lit(0), lambda a, m: a + m) / 12.0, 2))


def to_year(value: Column) -> Column:
    n = F.expr("1") * value.try_cast("int")
    return F.when(n.between(1950, 2100), n)
