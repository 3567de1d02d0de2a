"""Dates inside texts, moved by whole days."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postloom.functions import text as tx

#: Names of months, short or whole.
MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _moved(y: Column, m: Column, d: Column, days: Column, years: tuple[int, int]) -> Column:
    """The moved day; null where the year is outside the gate or there is no such day."""
    day = F.try_to_timestamp(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(y.between(*years) & (days != 0), F.date_add(day, days))


def numeric_date(s: Column, days: Column, years: tuple[int, int]) -> Column:
    """A date m/d/y or m-d-y, moved; two digits of a year stay two, and what is no date or outside the gate stays."""
    parts = F.split(s, "[/-]")
    sep = F.when(F.contains(s, F.lit("/")), "/").otherwise("-")
    m, d, y = (F.try_to_number(F.get(parts, F.lit(k)), F.lit("9999")).cast("int") for k in range(3))
    short = F.length(F.get(parts, F.lit(2))) == 2
    year = F.when(short, y + F.when(y < 50, 2000).otherwise(1900)).otherwise(y)
    return tx.once(_moved(year, m, d, days, years), lambda n: F.coalesce(F.concat(F.month(n).cast("string"), sep, F.day(n).cast("string"), sep, F.when(short, F.lpad((F.year(n) % 100).cast("string"), 2, "0")).otherwise(F.year(n).cast("string"))), s))


def worded_date(s: Column, days: Column, default_year: Column, years: tuple[int, int], month_first: bool) -> Column:
    """A date in words, moved; its month stays short or long, its ordinal fits the new day, a year that isn't written is the message's."""
    day_text = F.regexp_extract(s, r"(?:^|\s)([0-9]{1,2}(?:st|nd|rd|th)?)(?:\s|,|$)", 1)
    name = F.regexp_extract(s, rf"(?:^|\s)({MONTH})\b", 1) if not month_first else F.regexp_extract(s, rf"^({MONTH})", 1)
    year_text = F.regexp_extract(s, r"\s([0-9]{4})$", 1)
    months = F.array(*(F.lit(m[:3]) for m in MONTHS))
    m = F.array_position(months, F.initcap(F.left(name, F.lit(3)))).cast("int")
    d = F.try_to_number(F.regexp_extract(day_text, "^[0-9]+", 0), F.lit("99")).cast("int")
    y = F.when(year_text != "", F.try_to_number(year_text, F.lit("9999")).cast("int")).otherwise(default_year)
    ordinal = day_text.rlike("[a-z]")

    def written(n: Column) -> Column:
        long = F.get(F.array(*map(F.lit, MONTHS)), F.month(n) - 1)
        month = F.when(F.length(name) > 3, long).otherwise(F.left(long, F.lit(3)))
        k = F.day(n)
        end = F.when(k.between(11, 13), "th").when(k % 10 == 1, "st").when(k % 10 == 2, "nd").when(k % 10 == 3, "rd").otherwise("th")
        day = F.concat(k.cast("string"), F.when(ordinal, end).otherwise(""))
        tail = F.when(year_text != "", F.concat(F.lit(", " if month_first else " "), F.year(n).cast("string"))).otherwise("")
        return F.coalesce(F.concat(*((month, F.lit(" "), day) if month_first else (day, F.lit(" "), month)), tail), s)

    return tx.once(_moved(y, m, d, days, years), written)
