"""NUMBER, CURRENCY, PERCENT and DATEFMT in two locales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.fx import VALUE, Fx, as_date, as_number, first_error, made

# Currency sign, whether it leads, date pattern.
LOCALES = {"en": ("$", True, "YYYY-MM-DD"), "de": ("€", False, "DD.MM.YYYY")}


def grouped(x: Column, decimals: int, locale: str) -> Column:
    """Fixed decimals and thousands groups; ties as the exact binary value says, no minus on a zero."""
    text = F.format_number(x, decimals)
    text = F.when(text.rlike(r"^-[0.,]*$"), F.substring(text, 2, 1_000_000)).otherwise(text)
    text = F.translate(text, ",.", ".,") if locale == "de" else text
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(VALUE)).otherwise(text)


def number(x: object, decimals: int = 0, locale: str = "en") -> Fx:
    n = as_number(x)
    return made(grouped(n.value, decimals, locale), n.err, "text")


def currency(x: object, decimals: int = 2, symbol: str | None = None, locale: str = "en") -> Fx:
    sign, leads, _ = LOCALES[locale]
    n = as_number(x)
    text, sign = grouped(n.value, decimals, locale), F.lit(symbol or sign)
    return made(F.concat(sign, text) if leads else F.concat(text, F.lit(" "), sign), n.err, "text")


def percent(x: object, decimals: int = 0, locale: str = "en") -> Fx:
    n = as_number(x)
    return made(F.concat(grouped(n.value * 100, decimals, locale), F.lit("%")), n.err, "text")


def datefmt(x: object, pattern: str | None = None, locale: str = "en") -> Fx:
    """The tokens YYYY, YY, MM and DD, in this order, each wherever it stands."""
    d = as_date(x)
    year = F.lpad(F.year(d.value).cast("string"), 4, "0")
    text: Column = F.lit(pattern or LOCALES[locale][2])
    for token, part in (("YYYY", year), ("YY", F.right(year, F.lit(2))), ("MM", F.lpad(F.month(d.value).cast("string"), 2, "0")), ("DD", F.lpad(F.dayofmonth(d.value).cast("string"), 2, "0"))):
        text = F.replace(text, F.lit(token), part)
    return made(text, first_error(d), "text")
