"""Typed expressions whose errors are data.

An :class:`Fx` is a value column, a column with an error code (null where there is none) and the value's kind, which is known
when the plan is built. Kinds are ``num`` (double), ``int`` (bigint), ``bool``, ``text``, ``date``, ``time`` (timestamp),
``bytes``, ``null`` and ``mixed``: a VARIANT column, whose cells have kinds of their own. A value with an error is null. Everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The error codes.
TYPE, MISSING, PARSE, NAME, VALUE, DIV0, NA = "#TYPE", "#MISSING", "#PARSE", "#NAME", "#VALUE", "#DIV/0", "#N/A"

#: Days from 1970-01-01 to the first and last date of the years 1 to 9999.
DAY_NUMBERS = (-719_162, 2_932_896)
NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ISO_DATE = r"^(\d{1,4})-(\d{1,2})-(\d{1,2})$"


@dataclass(frozen=True)
class Fx:
    value: Column
    err: Column
    kind: str
    #: Of a mixed value: columns that hold its cells by kind, and their kind.
    cells: dict[str, Column] | None = None


def no_error() -> Column:
    return F.lit(None).cast("string")


def const(value: object) -> Fx:
    kind = "null" if value is None else "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "num" if isinstance(value, float) else "text"
    return Fx(F.lit(value).cast("string") if value is None else F.lit(value).cast("bigint") if kind == "int" else F.lit(value), no_error(), kind)


def error(code: str) -> Fx:
    return Fx(F.lit(None).cast("string"), F.lit(code), "null")


def kind_of(dtype: T.DataType) -> str:
    match dtype:
        case T.BooleanType():
            return "bool"
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "int"
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return "num"
        case T.DateType():
            return "date"
        case T.TimestampType() | T.TimestampNTZType():
            return "time"
        case T.BinaryType():
            return "bytes"
        case T.NullType():
            return "null"
        case T.VariantType():
            return "mixed"
        case _:
            return "text"


def field(df: DataFrame, name: str) -> Fx:
    """A field by its exact name; an absent one is null, not an error."""
    if name not in df.columns:
        return const(None)
    kind = kind_of(df.schema[name].dataType)
    c = df[name]
    if kind == "mixed":
        held = {k: df[f"{name}__{k}"] for k in (KIND, *CELL_KINDS)} if f"{name}__{KIND}" in df.columns else None
        return Fx(F.when(~F.is_variant_null(c), c), no_error(), kind, held)
    return Fx(c.cast("bigint") if kind == "int" else c.cast("double") if kind == "num" else c if kind in ("bool", "date", "time", "bytes") else c.cast("string"), no_error(), kind)


def param(params: dict[str, object], name: str) -> Fx:
    return const(params.get(name))


def of(x: object) -> Fx:
    return x if isinstance(x, Fx) else const(x)


#: Kinds of cells of a VARIANT column: how Spark's name of the cell's type begins, and the type the cell is read as. Objects and
#: arrays are their JSON text.
CELL_KINDS = {"bool": ("BOOLEAN", "boolean"), "int": ("BIGINT", "bigint"), "num": ("DECIMAL|DOUBLE|FLOAT", "double"), "date": ("DATE", "date"), "time": ("TIMESTAMP", "timestamp"), "bytes": ("BINARY", "binary"), "text": ("STRING|OBJECT|ARRAY", "string")}


KIND = "cell_kind"


def cells_of(v: Column) -> dict[str, Column]:
    told = F.schema_of_variant(v)
    kind = F.lit(None).cast("string")
    for k, (names, _) in CELL_KINDS.items():
        kind = F.when(told.rlike(f"^(?:{names})"), k).otherwise(kind)
    return {KIND: kind} | {k: F.when(told.rlike(f"^(?:{names})"), F.try_variant_get(v, "$", dtype)) for k, (names, dtype) in CELL_KINDS.items()}


def unpacked(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the cells of VARIANT columns in columns ``<name>__<kind>``, so that expressions read each cell's kind and value once
    and stay small enough for generated code; :func:`field` finds them."""
    return df.withColumns({f"{n}__{k}": c for n in names for k, c in cells_of(F.col(n)).items()})


def of_cells(f: Callable[[Fx], Column], x: Fx) -> Column:
    """``f`` of each cell of a mixed value by the cell's own kind; absent cells and JSON's null are of kind ``null``."""
    held = x.cells or cells_of(x.value)
    out = None
    for kind in CELL_KINDS:
        part = f(Fx(held[kind], x.err, kind))
        out = F.when(held[KIND] == kind, part) if out is None else out.when(held[KIND] == kind, part)
    return out.otherwise(f(Fx(F.lit(None).cast("string"), x.err, "null")))


def mixed(f: Callable[[Fx], Fx], x: Fx, kind: str) -> Fx:
    """A coercion ``f`` to ``kind`` of mixed cells."""
    return Fx(of_cells(lambda c: f(c).value, x), of_cells(lambda c: f(c).err, x), kind)


def first_error(*xs: Fx) -> Column:
    return F.coalesce(*(x.err for x in xs), no_error())


def made(value: Column, err: Column, kind: str) -> Fx:
    """A value that is null where there is an error."""
    return Fx(F.when(err.isNull(), value), err, kind)


def number_text(x: Column) -> Column:
    """A double as the shortest text that reads back the same, without exponent; whole numbers without a point."""
    plain = x.cast("string")
    wide = F.when(F.abs(x) < 1e19, x).try_cast("decimal(38,18)").cast("string")
    expanded = F.when(plain.contains("E"), F.regexp_replace(F.regexp_replace(wide, r"0+$", ""), r"\.$", "")).otherwise(F.regexp_replace(plain, r"\.0$", ""))
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit("#NUM")).when(whole, F.when(whole, x).cast("bigint").cast("string")).when(F.abs(x) < 1e19, expanded).otherwise(plain)


def display(x: object) -> Column:
    """The text shown for a value: null is empty, an error its code."""
    x = of(x)
    if x.kind == "mixed":
        return of_cells(display, x)
    shown = {
        "num": lambda: number_text(x.value),
        "int": lambda: x.value.cast("string"),
        "bool": lambda: F.when(x.value, "TRUE").otherwise(F.when(x.value.isNotNull(), "FALSE")),
        "date": lambda: F.date_format(x.value, "yyyy-MM-dd"),
        "time": lambda: F.date_format(x.value, "yyyy-MM-dd HH:mm:ss"),
        "bytes": lambda: F.concat(F.lit("<"), F.octet_length(x.value).cast("string"), F.lit(" bytes>")),
    }.get(x.kind, lambda: x.value.cast("string"))()
    return F.coalesce(x.err, shown, F.lit(""))


def as_number(x: object) -> Fx:
    """bool 1/0, null 0, dates as day number, times as milliseconds, numeric text parsed, other text ``#TYPE``."""
    x = of(x)
    if x.kind == "mixed":
        return mixed(as_number, x, "num")
    if x.kind in ("num", "int"):
        return made(F.coalesce(x.value.cast("double"), F.lit(0.0)), x.err, "num")
    if x.kind == "bool":
        return made(F.coalesce(x.value.cast("int").cast("double"), F.lit(0.0)), x.err, "num")
    if x.kind == "null":
        return made(F.lit(0.0), x.err, "num")
    if x.kind == "date":
        return made(F.coalesce(F.unix_date(x.value).cast("double"), F.lit(0.0)), x.err, "num")
    if x.kind == "time":
        return made(F.coalesce(F.unix_millis(x.value.cast("timestamp")).cast("double"), F.lit(0.0)), x.err, "num")
    if x.kind == "bytes":
        return made(F.lit(None).cast("double"), F.coalesce(x.err, F.lit(TYPE)), "num")
    t = F.trim(x.value)
    ok = t.rlike(NUMERIC_TEXT)
    bad = F.when(x.value.isNotNull() & ~ok, F.lit(TYPE))
    return made(F.when(x.value.isNull(), 0.0).when(ok, t.try_cast("double")), F.coalesce(x.err, bad), "num")


def as_bool(x: object) -> Fx:
    """Numbers other than 0, text true/1/yes against false/0/no/empty, null false; other text ``#TYPE``."""
    x = of(x)
    if x.kind == "mixed":
        return mixed(as_bool, x, "bool")
    if x.kind == "bool":
        return made(F.coalesce(x.value, F.lit(False)), x.err, "bool")
    if x.kind in ("num", "int"):
        return made(F.coalesce(x.value != 0, F.lit(False)), x.err, "bool")
    if x.kind == "null":
        return made(F.lit(False), x.err, "bool")
    if x.kind in ("date", "time", "bytes"):
        return made(F.lit(None).cast("boolean"), F.coalesce(x.err, F.lit(TYPE)), "bool")
    t = F.lower(F.trim(x.value))
    yes, no = t.isin("true", "1", "yes"), t.isin("false", "0", "no", "")
    return made(F.when(x.value.isNull(), False).when(yes, True).when(no, False), F.coalesce(x.err, F.when(x.value.isNotNull() & ~yes & ~no, F.lit(TYPE))), "bool")


def as_date(x: object) -> Fx:
    """Dates, the day of a time, day numbers of the years 1 to 9999 (others ``#VALUE``) and lenient ISO text (31 February is
    3 March); null ``#MISSING``."""
    x = of(x)
    if x.kind == "mixed":
        return mixed(as_date, x, "date")
    missing = F.when(x.value.isNull(), F.lit(MISSING))
    if x.kind == "date":
        return made(x.value, F.coalesce(x.err, missing), "date")
    if x.kind == "time":
        return made(x.value.cast("date"), F.coalesce(x.err, missing), "date")
    if x.kind in ("num", "int"):
        whole = F.when(x.value >= 0, F.floor(x.value)).otherwise(F.ceil(x.value))
        fits = whole.between(*DAY_NUMBERS)
        return made(F.date_from_unix_date(F.when(fits, whole).cast("int")), F.coalesce(x.err, missing, F.when(~fits, F.lit(VALUE))), "date")
    if x.kind == "null":
        return Fx(F.lit(None).cast("date"), F.coalesce(x.err, F.lit(MISSING)), "date")
    if x.kind in ("bool", "bytes"):
        return Fx(F.lit(None).cast("date"), F.coalesce(x.err, F.lit(TYPE)), "date")
    t = F.trim(x.value)
    y, m, d = (F.regexp_extract(t, ISO_DATE, i).try_cast("int") for i in (1, 2, 3))
    ok = t.rlike(ISO_DATE) & m.between(1, 12) & d.between(1, 31)
    return made(F.when(ok, F.date_add(F.make_date(y, F.when(ok, m), F.lit(1)), d - 1)), F.coalesce(x.err, missing, F.when(~F.coalesce(ok, F.lit(False)), F.lit(PARSE))), "date")


def _numbers(f, *xs: object) -> Fx:
    n = [as_number(x) for x in xs]
    return made(f(*(x.value for x in n)), first_error(*n), "num")


def add(a: object, b: object) -> Fx:
    return _numbers(lambda x, y: x + y, a, b)


def sub(a: object, b: object) -> Fx:
    return _numbers(lambda x, y: x - y, a, b)


def mul(a: object, b: object) -> Fx:
    return _numbers(lambda x, y: x * y, a, b)


def neg(a: object) -> Fx:
    return _numbers(lambda x: -x, a)


def div(a: object, b: object) -> Fx:
    a, b = as_number(a), as_number(b)
    err = F.coalesce(a.err, b.err, F.when(b.value == 0, F.lit(DIV0)))
    return made(F.try_divide(a.value, b.value), err, "num")


def concat(*xs: object) -> Fx:
    """The ``&`` of displayed values; null is empty, errors go through."""
    xs = tuple(of(x) for x in xs)
    return made(F.concat(*(display(x) for x in xs)), first_error(*xs), "text")


def equal(a: object, b: object) -> Fx:
    """Null equals null alone; numbers if both sides are, else displayed text."""
    a, b = of(a), of(b)
    na, nb = as_number(a), as_number(b)
    both = na.err.isNull() & nb.err.isNull()
    null_a, null_b = a.value.isNull(), b.value.isNull()
    same = F.when(null_a | null_b, null_a & null_b).when(both, na.value == nb.value).otherwise(display(a) == display(b))
    return made(same, first_error(a, b), "bool")


def unequal(a: object, b: object) -> Fx:
    x = equal(a, b)
    return Fx(~x.value, x.err, "bool")


def compare(op: str, a: object, b: object) -> Fx:
    """``<``, ``<=``, ``>``, ``>=``: numbers if both sides are (null is 0), else displayed text; NaN gives ``#TYPE``."""
    a, b = of(a), of(b)
    na, nb = as_number(a), as_number(b)
    f = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    both = na.err.isNull() & nb.err.isNull()
    odd = F.when(both & (F.isnan(na.value) | F.isnan(nb.value)), F.lit(TYPE))
    return made(F.when(both, f(na.value, nb.value)).otherwise(f(display(a), display(b))), F.coalesce(a.err, b.err, odd), "bool")


def fires(x: object) -> Column:
    """Whether a predicate is true; errors and nulls are false."""
    return F.coalesce(as_bool(x).value, F.lit(False))


def every(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, xs, F.lit(True))
