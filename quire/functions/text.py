"""CONCAT, UPPER, LOWER, TRIM, LEN, LEFT, RIGHT, SUBSTITUTE, MID, PROPER, FIND, TEXTJOIN, REPT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.fx import VALUE, Fx, as_number, concat, display, first_error, made, of

#: Bytes of the longest text that REPT makes.
MOST_BYTES = 1 << 27

__all__ = "concat upper lower trim len_ left right substitute mid proper find textjoin rept".split()


def _text(f, x: object, kind: str = "text") -> Fx:
    x = of(x)
    return made(f(display(x)), x.err, kind)


def _int(x: object) -> tuple[Column, Fx]:
    """The whole part, held within the range of an int: no text is longer than that."""
    n = as_number(x)
    whole = F.when(n.value >= 0, F.floor(n.value)).otherwise(F.ceil(n.value))
    return F.greatest(F.least(whole, F.lit(2**31 - 1)), F.lit(-(2**31))).cast("int"), n


def upper(x: object) -> Fx:
    return _text(F.upper, x)


def lower(x: object) -> Fx:
    return _text(F.lower, x)


def trim(x: object) -> Fx:
    return _text(lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), x)


def len_(x: object) -> Fx:
    return _text(lambda s: F.length(s).cast("bigint"), x, "int")


def left(x: object, n: object) -> Fx:
    x, (k, m) = of(x), _int(n)
    return made(F.substring(display(x), F.lit(1), F.greatest(k, F.lit(0))), first_error(x, m), "text")


def right(x: object, n: object) -> Fx:
    x, (k, m) = of(x), _int(n)
    k = F.greatest(k, F.lit(0))
    return made(F.right(display(x), k), first_error(x, m), "text")


def substitute(x: object, find: object, put: object) -> Fx:
    x, find, put = of(x), of(find), of(put)
    return made(F.replace(display(x), display(find), display(put)), first_error(x, find, put), "text")


def mid(x: object, start: object, n: object) -> Fx:
    """From 1; a start below it or a negative length is ``#VALUE``, past the end is empty."""
    x, (at, a), (k, b) = of(x), _int(start), _int(n)
    bad = F.when((at < 1) | (k < 0), F.lit(VALUE))
    return made(F.substring(display(x), at, k), F.coalesce(first_error(x, a, b), bad), "text")


def proper(x: object) -> Fx:
    """Words are runs of letters: the first letter upper, the others lower."""
    parts = lambda s: F.regexp_extract_all(s, F.lit(r"(\p{IsAlphabetic}+|\P{IsAlphabetic}+)"), F.lit(1))
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))
    return _text(lambda s: F.array_join(F.transform(parts(s), word), ""), x)


def find(needle: object, x: object, start: object = 1) -> Fx:
    """The place from 1; not found, or a start below 1, is ``#VALUE``; an empty needle is found at the start."""
    needle, x, (at, m) = of(needle), of(x), _int(start)
    n, s = display(needle), display(x)
    empty = (n == "") & (at <= F.length(s) + 1)
    place = F.when(empty, at).otherwise(F.position(n, s, at))
    bad = F.when((at < 1) | (place == 0) | ((n == "") & ~empty), F.lit(VALUE))
    return made(place.cast("bigint"), F.coalesce(first_error(needle, x, m), bad), "int")


def textjoin(delimiter: object, *xs: object) -> Fx:
    """Without nulls and empty texts."""
    d, parts = of(delimiter), [of(x) for x in xs]
    shown = F.filter(F.array(*(display(x) for x in parts)), lambda s: s != "")
    return made(F.concat_ws("", F.slice(shown, 1, 1), F.array_join(F.transform(F.slice(shown, 2, 1_000_000), lambda s: F.concat(display(d), s)), "")), first_error(d, *parts), "text")


def rept(x: object, n: object) -> Fx:
    x, (k, m) = of(x), _int(n)
    """A negative count is ``#VALUE``, and so is a result that no value can hold."""
    too_long = F.octet_length(display(x)).cast("double") * k > MOST_BYTES
    bad = F.when((k < 0) | too_long, F.lit(VALUE))
    return made(F.repeat(display(x), F.when(~too_long, k)), F.coalesce(first_error(x, m), bad), "text")
