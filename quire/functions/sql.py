"""The fixed-arity functions as SQL functions, so that recipes may be SQL text. Spark inlines their bodies into the plan.

Errors are null here, as in SQL's own ``try_`` functions; the Column functions keep their codes.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _whole(f: str, x: str) -> str:
    """Floor and ceil give bigint; beyond its range a double is whole already."""
    return f"CASE WHEN abs({x}) < 4e18 THEN CAST({f}({x}) AS DOUBLE) ELSE {x} END"


#: Name, parameters, result and body. Defaults are given where an argument may be left out.
FUNCTIONS: tuple[tuple[str, str, str, str], ...] = (
    ("fx_number", "x DOUBLE, d INT DEFAULT 0", "STRING", "regexp_replace(format_number(x, d), '^-([0.,]*)$', '$1')"),
    ("fx_currency", "x DOUBLE, d INT DEFAULT 2, sym STRING DEFAULT '$'", "STRING", "concat(sym, regexp_replace(format_number(x, d), '^-([0.,]*)$', '$1'))"),
    ("fx_percent", "x DOUBLE, d INT DEFAULT 0", "STRING", "concat(regexp_replace(format_number(x * 100, d), '^-([0.,]*)$', '$1'), '%')"),
    ("fx_datefmt", "x DATE, pattern STRING DEFAULT 'YYYY-MM-DD'", "STRING", "replace(replace(replace(replace(pattern, 'YYYY', lpad(year(x), 4, '0')), 'YY', right(lpad(year(x), 4, '0'), 2)), 'MM', lpad(month(x), 2, '0')), 'DD', lpad(day(x), 2, '0'))"),
    ("fx_isblank", "x STRING", "BOOLEAN", "x IS NULL OR x = ''"),
    ("fx_round", "x DOUBLE, d INT DEFAULT 0", "DOUBLE", f"sign(x) * (CASE WHEN abs(x * pow(10, d)) - {_whole('floor', 'abs(x * pow(10, d))')} >= 0.5 THEN 1D ELSE 0D END + {_whole('floor', 'abs(x * pow(10, d))')}) / pow(10, d)"),
    ("fx_trunc", "x DOUBLE, d INT DEFAULT 0", "DOUBLE", f"CASE WHEN x < 0 THEN {_whole('ceil', 'x * pow(10, d)')} ELSE {_whole('floor', 'x * pow(10, d)')} END / pow(10, d)"),
    ("fx_floor", "x DOUBLE", "DOUBLE", _whole("floor", "x")),
    ("fx_ceiling", "x DOUBLE", "DOUBLE", _whole("ceil", "x")),
    ("fx_mod", "a DOUBLE, b DOUBLE", "DOUBLE", f"a - b * {_whole('floor', 'try_divide(a, b)')}"),
    ("fx_power", "a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN NOT (isnan(pow(a, b)) OR abs(pow(a, b)) = double('Infinity')) THEN pow(a, b) END"),
    ("fx_sign", "x DOUBLE", "DOUBLE", "CASE WHEN x > 0 THEN 1D WHEN x < 0 THEN -1D ELSE 0D END"),
    ("fx_weekday", "x DATE", "INT", "dayofweek(x)"),
    ("fx_trim", "x STRING", "STRING", "regexp_replace(x, '(?U)^\\\\s+|\\\\s+$', '')"),
    ("fx_mid", "x STRING, start INT, n INT", "STRING", "CASE WHEN start >= 1 AND n >= 0 THEN substring(x, start, n) END"),
    ("fx_find", "needle STRING, x STRING, start INT DEFAULT 1", "INT", "CASE WHEN start < 1 THEN NULL WHEN needle = '' THEN start ELSE nullif(locate(needle, x, start), 0) END"),
    ("fx_proper", "x STRING", "STRING", "array_join(transform(regexp_extract_all(x, '(\\\\p{IsAlphabetic}+|\\\\P{IsAlphabetic}+)', 1), w -> concat(upper(left(w, 1)), lower(substring(w, 2)))), '')"),
    ("fx_rept", "x STRING, n INT", "STRING", "CASE WHEN n >= 0 THEN repeat(x, n) END"),
    ("fx_left", "x STRING, n INT", "STRING", "left(x, greatest(n, 0))"),
    ("fx_right", "x STRING, n INT", "STRING", "right(x, greatest(n, 0))"),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
