"""ABS, ROUND, FLOOR, CEILING, MIN, MAX, SUM, MOD, POWER, TRUNC, SIGN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.fx import DIV0, VALUE, Fx, _numbers, as_number, first_error, made, of


def abs_(x: object) -> Fx:
    return _numbers(F.abs, x)


def _whole(f, x: Column) -> Column:
    """Spark's floor and ceil give bigint; beyond its range a double is whole already."""
    small = F.abs(x) < 2.0**62
    return F.when(small, f(F.when(small, x)).cast("double")).otherwise(x)


def floor(x: object) -> Fx:
    return _numbers(lambda v: _whole(F.floor, v), x)


def ceiling(x: object) -> Fx:
    return _numbers(lambda v: _whole(F.ceil, v), x)


def round_(x: object, digits: int = 0) -> Fx:
    """``round(x * 10^d) / 10^d``, halves away from zero: the fraction is compared with a half, as adding one would round."""
    scale = 10.0**digits

    def rounded(v):
        size = F.abs(v * scale)
        below = _whole(F.floor, size)
        return F.signum(v) * F.when(size - below >= 0.5, below + 1).otherwise(below) / scale

    return _numbers(rounded, x)


def trunc(x: object, digits: int = 0) -> Fx:
    scale = 10.0**digits
    return _numbers(lambda v: F.when(v < 0, _whole(F.ceil, v * scale)).otherwise(_whole(F.floor, v * scale)) / scale, x)


def _extreme(pick, xs: tuple) -> Fx:
    n = [as_number(x) for x in xs]
    values = [F.when(of(x).value.isNotNull() & ~F.isnan(v.value), v.value) for x, v in zip(xs, n, strict=True)]
    return made(pick(*values) if len(values) > 1 else values[0], first_error(*n), "num")


def min_(*xs: object) -> Fx:
    """Of one row's arguments; nulls are skipped, all null is null."""
    return _extreme(F.least, xs)


def max_(*xs: object) -> Fx:
    return _extreme(F.greatest, xs)


def sum_(*xs: object) -> Fx:
    return _numbers(lambda *v: sum(v[1:], v[0]), *xs)


def mod(a: object, b: object) -> Fx:
    """With the sign of the divisor."""
    a, b = as_number(a), as_number(b)
    err = F.coalesce(a.err, b.err, F.when(b.value == 0, F.lit(DIV0)))
    return made(a.value - b.value * _whole(F.floor, F.try_divide(a.value, b.value)), err, "num")


def power(a: object, b: object) -> Fx:
    a, b = as_number(a), as_number(b)
    p = F.pow(a.value, b.value)
    return made(p, F.coalesce(a.err, b.err, F.when(F.isnan(p) | (F.abs(p) == float("inf")), F.lit(VALUE))), "num")


def sign(x: object) -> Fx:
    return _numbers(lambda v: F.when(v > 0, 1.0).when(v < 0, -1.0).otherwise(0.0), x)
