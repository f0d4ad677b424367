"""Dates, amounts, check digits and identifier shapes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Month names in Russian (two cases), Kazakh and English.
MONTHS = {
    "январь": 1, "января": 1, "февраль": 2, "февраля": 2, "март": 3, "марта": 3, "апрель": 4, "апреля": 4, "май": 5, "мая": 5, "июнь": 6, "июня": 6,
    "июль": 7, "июля": 7, "август": 8, "августа": 8, "сентябрь": 9, "сентября": 9, "октябрь": 10, "октября": 10, "ноябрь": 11, "ноября": 11, "декабрь": 12, "декабря": 12,
    "қаңтар": 1, "ақпан": 2, "наурыз": 3, "сәуір": 4, "мамыр": 5, "маусым": 6, "шілде": 7, "тамыз": 8, "қыркүйек": 9, "қазан": 10, "қараша": 11, "желтоқсан": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}


def month(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(table, c)


def calendar_date(y: Column, m: Column, d: Column) -> Column:
    """ISO date, or null if there is no such day; years 1 to 9999."""
    good = y.between(1, 9999) & m.between(1, 12) & d.between(1, 31)
    return F.when(good, F.date_format(F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m, d), "yyyy-M-d"), "yyyy-MM-dd"))


def amount(source: Column) -> Column:
    """A decimal string of a written amount: of commas and dots only the last may be decimal, if one or two digits follow; null without digits."""
    plain = F.regexp_replace(source, r"[^0-9,.]", "")

    def read(c: Column) -> Column:
        decimal = c.rlike(r"[,.][0-9]{1,2}$")
        whole = F.regexp_replace(F.when(decimal, F.regexp_extract(c, r"^(.*)[,.][0-9]{1,2}$", 1)).otherwise(c), "[,.]", "")
        part = F.regexp_extract(c, r"[,.]([0-9]{1,2})$", 1)
        bare = F.regexp_replace(whole, "^0+(?=[0-9])", "")
        return F.when(c.rlike("[0-9]"), F.when(decimal, F.concat(F.when(bare == "", "0").otherwise(bare), F.lit("."), part)).otherwise(bare))

    return let(plain, read)


def percent(c: Column) -> Column:
    """A number without leading and trailing zeros and with a decimal point."""
    dotted = F.regexp_replace(F.translate(c, ",", "."), "^0+(?=[0-9])", "")
    return F.when(dotted.contains("."), F.regexp_replace(F.regexp_replace(dotted, "0+$", ""), r"\.$", "")).otherwise(dotted)


def mod97(c: Column) -> Column:
    """Whether an account number's check digits hold: rotated by four, letters as 10 to 35, remainder 1; null under four characters or for other ones."""
    rotated = F.concat(F.substring(c, 5, 10_000), F.substring(c, 1, 4))
    step = lambda a, ch: F.when(ch.between("0", "9"), (a * 10 + F.try_to_number(ch, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(ch) - 55) % 97)
    rest = F.aggregate(F.filter(F.split(rotated, ""), lambda ch: ch != ""), F.lit(0), step)
    return F.when((F.length(c) >= 4) & c.rlike("^[A-Z0-9]+$"), rest == 1)


def status(format_valid: Column) -> Column:
    return F.when(format_valid.isNull(), "unverified").when(format_valid, "valid").otherwise("invalid")


def gap_score(gap: Column, most: float) -> Column:
    if most == 0:
        return F.when(gap == 0, 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), 0.10 * (1.0 - F.least(F.lit(1.0), gap / most)))
