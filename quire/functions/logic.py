"""IF, AND, OR, NOT, ISBLANK, ISERROR, COALESCE, SWITCH, IFERROR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.fx import Fx, as_bool, display, made, no_error, of, of_cells


def _common(xs: list[Fx]) -> tuple[list[Column], str]:
    """The values as one type: their own if they share it, else what is displayed."""
    kinds = {x.kind for x in xs} - {"null"}
    if kinds <= {"num", "int"} and kinds:
        return [x.value.cast("double") for x in xs], "num"
    if len(kinds) <= 1:
        kind = next(iter(kinds), "null")
        types = {"bool": "boolean", "date": "date", "time": "timestamp", "bytes": "binary", "mixed": "variant"}
        return [x.value if x.kind == kind else F.lit(None).cast(types.get(kind, "string")) for x in xs], kind
    return [F.when(x.value.isNotNull(), display(Fx(x.value, no_error(), x.kind))) for x in xs], "text"


def if_(c: object, a: object, b: object) -> Fx:
    c, a, b = as_bool(c), of(a), of(b)
    (va, vb), kind = _common([a, b])
    return made(F.when(c.value, va).otherwise(vb), F.when(c.err.isNotNull(), c.err).when(c.value, a.err).otherwise(b.err), kind)


def _fold(xs: tuple, stop: bool) -> Fx:
    """Left to right; an error counts only if it is reached."""
    value, err = F.lit(not stop), no_error()
    for x in reversed([as_bool(x) for x in xs]):
        here = F.coalesce(x.value == stop, F.lit(False))
        err = F.when(x.err.isNotNull(), x.err).when(here, no_error()).otherwise(err)
        value = F.when(here, F.lit(stop)).otherwise(value)
    return made(value, err, "bool")


def and_(*xs: object) -> Fx:
    return _fold(xs, False)


def or_(*xs: object) -> Fx:
    return _fold(xs, True)


def not_(x: object) -> Fx:
    b = as_bool(x)
    return Fx(~b.value, b.err, "bool")


def isblank(x: object) -> Fx:
    x = of(x)
    if x.kind == "mixed":
        return made(of_cells(lambda c: isblank(c).value, x), x.err, "bool")
    blank = x.value.isNull() | (x.value == "") if x.kind == "text" else x.value.isNull()
    return made(blank, x.err, "bool")


def iserror(x: object) -> Fx:
    return Fx(of(x).err.isNotNull(), no_error(), "bool")


def coalesce(*xs: object) -> Fx:
    """The first that is neither null nor an error."""
    parts = [of(x) for x in xs]
    values, kind = _common(parts)
    return Fx(F.coalesce(*(F.when(x.err.isNull(), v) for x, v in zip(parts, values, strict=True))), no_error(), kind)


def switch(v: object, *cases: object) -> Fx:
    """``case, result`` pairs and maybe a default, compared as displayed: 1 matches "1". No match is null."""
    v, parts = of(v), [of(x) for x in cases]
    default = parts.pop() if len(parts) % 2 else of(None)
    results = [*parts[1::2], default]
    values, kind = _common(results)
    value, err = values[-1], default.err
    for test, got, x in reversed(list(zip(parts[::2], values, results, strict=False))):
        hit = display(v) == display(test)
        value, err = F.when(hit, got).otherwise(value), F.when(hit, x.err).otherwise(err)
    return made(value, F.coalesce(v.err, err), kind)


def iferror(v: object, fallback: object) -> Fx:
    v, f = of(v), of(fallback)
    (a, b), kind = _common([v, f])
    bad = v.err.isNotNull()
    return made(F.when(bad, b).otherwise(a), F.when(bad, f.err), kind)
