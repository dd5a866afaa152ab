"""The 42 functions over typed expressions with errors as data, and their names."""

from __future__ import annotations

from collections.abc import Callable

from quire.functions import formats, logic, maths, temporal, text
from quire.functions.fx import NAME, VALUE, Fx, error

#: Function, fewest and most arguments (None: any number).
REGISTRY: dict[str, tuple[Callable[..., Fx], int, int | None]] = {
    "NUMBER": (formats.number, 1, 2), "CURRENCY": (formats.currency, 1, 3), "PERCENT": (formats.percent, 1, 2), "DATEFMT": (formats.datefmt, 1, 2),
    "IF": (logic.if_, 3, 3), "AND": (logic.and_, 1, None), "OR": (logic.or_, 1, None), "NOT": (logic.not_, 1, 1), "ISBLANK": (logic.isblank, 1, 1),
    "ISERROR": (logic.iserror, 1, 1), "COALESCE": (logic.coalesce, 1, None), "SWITCH": (logic.switch, 3, None), "IFERROR": (logic.iferror, 2, 2),
    "ABS": (maths.abs_, 1, 1), "ROUND": (maths.round_, 1, 2), "FLOOR": (maths.floor, 1, 1), "CEILING": (maths.ceiling, 1, 1), "MIN": (maths.min_, 1, None),
    "MAX": (maths.max_, 1, None), "SUM": (maths.sum_, 1, None), "MOD": (maths.mod, 2, 2), "POWER": (maths.power, 2, 2), "TRUNC": (maths.trunc, 1, 2), "SIGN": (maths.sign, 1, 1),
    "YEAR": (temporal.year, 1, 1), "MONTH": (temporal.month, 1, 1), "DAY": (temporal.day, 1, 1), "TODAY": (temporal.today, 1, 1), "WEEKDAY": (temporal.weekday, 1, 1),
    "CONCAT": (text.concat, 1, None), "UPPER": (text.upper, 1, 1), "LOWER": (text.lower, 1, 1), "TRIM": (text.trim, 1, 1), "LEN": (text.len_, 1, 1),
    "LEFT": (text.left, 2, 2), "RIGHT": (text.right, 2, 2), "SUBSTITUTE": (text.substitute, 3, 3), "MID": (text.mid, 3, 3), "PROPER": (text.proper, 1, 1),
    "FIND": (text.find, 2, 3), "TEXTJOIN": (text.textjoin, 2, None), "REPT": (text.rept, 2, 2),
}


def call(name: str, *args: object) -> Fx:
    """A function by name, in any case. An unknown name is ``#NAME``, a wrong number of arguments ``#VALUE``."""
    if name.upper() not in REGISTRY:
        return error(NAME)
    f, least, most = REGISTRY[name.upper()]
    if len(args) < least or (most is not None and len(args) > most):
        return error(VALUE)
    return f(*args)
