"""Golden values of the functions."""

from datetime import date

from quire.functions import REGISTRY, call
from quire.functions.fx import add, compare, concat, display, div, equal

# Calls and the results that have to come.
CASES = [
    ("ROUND", (0.49999999999999994,), "0"), ("ROUND", (-0.5,), "-1"), ("ROUND", (4503599627370497.5,), "4503599627370498"), ("LEFT", ("abc", 1e12), "abc"), ("RIGHT", ("abc", 1e12), "abc"), ("LEFT", ("abc", -1e12), ""), ("MID", ("abc", 1, 1e12), "abc"), ("MID", ("abc", 1e12, 1), ""),
    ("FIND", ("b", "abc", 1e12), "#VALUE"), ("REPT", ("ab", 1e12), "#VALUE"), ("YEAR", (1e12,), "#VALUE"), ("MONTH", (-1e300,), "#VALUE"), ("DATEFMT", (1e12,), "#VALUE"), ("YEAR", (2932896,), "9999"),
    ("NUMBER", (1234.56, 2), "1,234.56"), ("NUMBER", (1000000,), "1,000,000"), ("NUMBER", (-5,), "-5"), ("NUMBER", (0.125, 2), "0.12"), ("NUMBER", (-0.001, 2), "0.00"), ("NUMBER", ("x",), "#TYPE"),
    ("CURRENCY", (1234.56,), "$1,234.56"), ("CURRENCY", (9.5, 2, "€"), "€9.50"), ("PERCENT", (0.125, 1), "12.5%"), ("PERCENT", (1,), "100%"), ("DATEFMT", ("2026-06-08", "DD/MM/YYYY"), "08/06/2026"), ("DATEFMT", ("2026-02-31",), "2026-03-03"),
    ("IF", (True, "a", "b"), "a"), ("IF", ("maybe", 1, 2), "#TYPE"), ("AND", (True, 1, "yes"), "TRUE"), ("AND", (False, "oops"), "FALSE"), ("OR", (0, "true"), "TRUE"), ("NOT", (0,), "TRUE"), ("ISBLANK", ("",), "TRUE"), ("ISBLANK", (None,), "TRUE"),
    ("SWITCH", ("q", "a", "x", "z"), "z"), ("SWITCH", (1, "1", "one"), "one"), ("COALESCE", (None, None), ""), ("COALESCE", (None, 2), "2"),
    ("ABS", (-3.5,), "3.5"), ("ROUND", (3.567, 2), "3.57"), ("ROUND", (2.5,), "3"), ("ROUND", (1.005, 2), "1"), ("FLOOR", (-1.5,), "-2"), ("CEILING", (1.2,), "2"), ("MIN", (3, None, 2), "2"), ("MAX", (None, None), ""), ("SUM", (1, None, 2), "3"),
    ("MOD", (-1, 3), "2"), ("MOD", (7, -3), "-2"), ("MOD", (1, 0), "#DIV/0"), ("POWER", (9, 0.5), "3"), ("POWER", (-8, 0.5), "#VALUE"), ("TRUNC", (-2.9,), "-2"), ("SIGN", (-4,), "-1"),
    ("WEEKDAY", ("1970-01-01",), "5"), ("WEEKDAY", ("1970-01-04",), "1"), ("YEAR", ("2026-06-08",), "2026"), ("MONTH", (None,), "#MISSING"), ("DAY", ("x",), "#PARSE"),
    ("UPPER", ("é",), "É"), ("LOWER", ("ÀB",), "àb"), ("TRIM", ("  a b\t",), "a b"), ("LEN", ("héllo",), "5"), ("LEFT", ("abc", 2), "ab"), ("LEFT", ("abc", -1), ""), ("RIGHT", ("abc", 2), "bc"), ("SUBSTITUTE", ("aXbX", "X", "-"), "a-b-"), ("SUBSTITUTE", ("a", "", "-"), "a"),
    ("MID", ("hi", 9, 3), ""), ("MID", ("hello", 0, 3), "#VALUE"), ("MID", ("hello", 2, 3), "ell"), ("PROPER", ("o'brien-sMITH",), "O'Brien-Smith"), ("FIND", ("o", "hello world", 6), "8"), ("FIND", ("z", "abc"), "#VALUE"), ("FIND", ("", "abc", 2), "2"),
    ("TEXTJOIN", (" - ", "Acme", "", "Red"), "Acme - Red"), ("REPT", ("ab", 3), "ababab"), ("REPT", ("ab", -1), "#VALUE"), ("CONCAT", ("a", None, 1.5, True), "a1.5TRUE"), ("NOPE", (1,), "#NAME"), ("ABS", (1, 2), "#VALUE"),
]


def test_goldens(spark):
    row = spark.range(1).select(*(display(call(n, *a)).alias(f"c{i}") for i, (n, a, _) in enumerate(CASES))).first()
    assert [(n, a, row[i]) for i, (n, a, _) in enumerate(CASES)] == [(n, a, w) for n, a, w in CASES]


def test_operators(spark):
    today = call("TODAY", date(2026, 6, 8))
    row = spark.range(1).select(
        display(add("2", None)), display(div(1, 0)), display(concat("a", None, 2.0)), display(equal(1, "1")), display(equal(None, 0)), display(compare("<", "10", 9)), display(compare("<", "b", "a")),
        display(call("IFERROR", call("MOD", 1, 0), "n/a")), display(call("ISERROR", div(1, 0))), display(call("YEAR", today)), display(1e20), display(0.0001), display(12345678.5), display(REGISTRY["CURRENCY"][0](19.99, locale="de")),
    ).first()
    assert list(row) == ["2", "#DIV/0", "a2", "TRUE", "FALSE", "FALSE", "FALSE", "n/a", "TRUE", "2026", "1.0E20", "0.0001", "12345678.5", "19,99 €"]


def test_all_functions_are_there():
    assert len(REGISTRY) == 42


def test_sql_functions(spark):
    from quire.functions.sql import register

    assert len(register(spark)) == 20
    row = spark.sql("SELECT fx_number(1234.567D, 2), fx_number(-0.001D, 2), fx_round(1.005D, 2), fx_datefmt(DATE'2026-06-08', 'DD/MM/YY'), fx_trim('  a '), fx_find('z', 'abc'), fx_rept('ab', -1), fx_proper('o''brien-sMITH'), fx_power(-8D, 0.5D), fx_left('abc', -1)").first()
    assert list(row) == ["1,234.57", "0.00", 1.0, "08/06/26", "a", None, None, "O'Brien-Smith", None, ""]


def test_sql_functions_beyond_bigint(spark):
    from quire.functions.sql import register

    register(spark)
    row = spark.sql("SELECT fx_floor(1e19D), fx_ceiling(-1e19D), fx_round(1e19D), fx_trunc(-1e19D), fx_round(0.49999999999999994D), fx_round(-2.5D), fx_mod(1e19D, 7D) < 7, fx_floor(-1.5D), fx_trunc(-2.9D)").first()
    assert list(row) == [1e19, -1e19, 1e19, -1e19, 0.0, -3.0, True, -2.0, -2.0]


def test_mixed_cells_are_as_typed_ones(spark):
    """Operators over cells of VARIANT columns against the same values with kinds known beforehand."""
    import json

    from quire.functions.fx import as_bool, as_date, field, unpacked

    cells = [None, True, False, 0, 7, -3, 2.5, "7", "2.50", "", "yes", "abc", "2026-06-08", "2026-02-31", 1e300, 20_000]
    ops = {
        "display": display, "add": lambda a: add(a, 7).value, "add_error": lambda a: add(a, 7).err, "equal": lambda a: equal(a, "7").value, "less": lambda a: compare("<", a, 7).value,
        "bool": lambda a: as_bool(a).value, "date": lambda a: as_date(a).value, "date_error": lambda a: as_date(a).err, "blank": lambda a: call("ISBLANK", a).value, "upper": lambda a: display(call("UPPER", a)),
    }
    df = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(cells)], "i int, a string").selectExpr("i", "parse_json(a) AS a").transform(lambda d: unpacked(d, "a"))
    got = {n: {r.i: r.x for r in df.select("i", f(field(df, "a")).alias("x")).collect()} for n, f in ops.items()}
    kinds = {type(None): "string", bool: "boolean", int: "bigint", float: "double", str: "string"}
    for kind, dtype in kinds.items():
        typed = spark.createDataFrame([(i, a) for i, a in enumerate(cells) if type(a) is kind], f"i int, a {dtype}")
        for r in typed.select("i", *(f(None if a is None else field(typed, "a")).alias(n) for n, f in ops.items() for a in [None if kind is type(None) else "a"])).collect():
            assert r.asDict() == {"i": r.i} | {n: got[n][r.i] for n in ops}, cells[r.i]


def test_mixed_cells_of_other_kinds(spark):
    """Dates, times, bytes, objects, absent columns' nulls and a whole column without cells."""
    from quire.functions.fx import as_date, field

    df = spark.sql("SELECT variant_get(to_variant_object(named_struct('d', DATE'2026-06-08', 't', TIMESTAMP'2026-06-08 10:00:00', 'b', X'0102', 'o', named_struct('k', 1))), p, 'variant') AS v FROM VALUES ('$.d'), ('$.t'), ('$.b'), ('$.o'), ('$.none') AS t(p)")
    rows = df.select(display(field(df, "v")), display(as_date(field(df, "v"))), display(add(field(df, "v"), 1))).collect()
    assert [tuple(r) for r in rows] == [("2026-06-08", "2026-06-08", "20613"), ("2026-06-08 10:00:00", "2026-06-08", "1780912800001"), ("<2 bytes>", "#TYPE", "#TYPE"), ('{"k":1}', "#PARSE", "#TYPE"), ("", "#MISSING", "1")]
    assert spark.sql("SELECT parse_json('1') AS v WHERE false").transform(lambda d: d.select(display(field(d, "v")))).count() == 0
