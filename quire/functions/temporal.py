"""YEAR, MONTH, DAY, TODAY, WEEKDAY."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quire.functions.fx import Fx, as_date, made, no_error


def _part(f, x: object) -> Fx:
    d = as_date(x)
    return made(f(d.value).cast("bigint"), d.err, "int")


def year(x: object) -> Fx:
    return _part(F.year, x)


def month(x: object) -> Fx:
    return _part(F.month, x)


def day(x: object) -> Fx:
    return _part(F.dayofmonth, x)


def weekday(x: object) -> Fx:
    """1 is Sunday, 7 Saturday."""
    return _part(F.dayofweek, x)


def today(clock: date) -> Fx:
    """The run's date, which the caller gives: results never depend on the wall clock."""
    return Fx(F.lit(clock), no_error(), "date")
