"""A kept order under appends, binding states with one winner among writers, and texts in order."""

import json
import random

import pytest

from quire.operators import ordered, shape
from quire.sources import files
from quire.streaming.state import BindingState, Conflict

SCHEMA = "a long, b string"


def test_appends_number_like_a_fresh_index(spark, tmp_path):
    rng = random.Random(9)
    make = lambda n, lo, hi: [(rng.choice([None, rng.randrange(lo, hi)]) if rng.random() < 0.1 else rng.randrange(lo, hi), rng.choice(["x", "y", None])) for _ in range(n)]
    rows, folder = make(400, 0, 1000), str(tmp_path / "o")
    ordered.create(spark.createDataFrame(rows, SCHEMA), ["a"], folder, rows_per_range=50)
    for more in (make(30, 0, 1000), make(200, 5000, 6000), [(None, None)] * 3, [], make(5, -90, -80)):
        ordered.append(spark.createDataFrame(more, SCHEMA), ["a"], folder, rows_per_range=50)
        rows += more
        got = sorted((r.row_idx, r.a, r.b) for r in ordered.read(spark, folder).collect())
        want = sorted(rows, key=lambda r: tuple((x is not None, x or ("" if i else 0)) for i, x in enumerate(r)))
        assert [x[1:] for x in got] == want and [x[0] for x in got] == list(range(len(rows)))
    fresh = shape.stable_index(spark.createDataFrame(rows, SCHEMA), ["a"])
    assert sorted(map(str, fresh.collect())) == sorted(map(str, ordered.read(spark, folder).select(*fresh.columns).collect()))


def test_untouched_ranges_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "o")
    ordered.create(spark.range(1000).selectExpr("id AS a", "'x' AS b"), ["a"], folder, rows_per_range=100)
    touched = ordered.append(spark.createDataFrame([(555, "y"), (556, "y")], SCHEMA), ["a"], folder, rows_per_range=100)
    assert 1 <= len(touched) <= 2
    _, ranges = ordered._manifest(spark, folder)
    versions = [r.version for r in ranges.collect()]
    assert versions.count(0) >= 8 and 1 <= versions.count(1) <= 4 and ordered.read(spark, folder).where("a = 999").first().row_idx == 1001


def test_ranges_grow_slower_than_rows(spark, tmp_path):
    """Four times the rows make twice the ranges beyond a hundred, so that what reaches the driver for each stays small."""
    made = {}
    for n in (4_000, 16_000):
        folder = str(tmp_path / str(n))
        ordered.create(spark.range(n).selectExpr("id AS a", "'x' AS b"), ["a"], folder, rows_per_range=10)
        made[n] = ordered._manifest(spark, folder)[1].count()
        assert ordered.read(spark, folder).where("a <> row_idx").isEmpty()
    assert 150 <= made[4_000] <= 250 and 300 <= made[16_000] <= 500


def test_an_empty_order(spark, tmp_path):
    folder = str(tmp_path / "o")
    ordered.create(spark.createDataFrame([], SCHEMA), ["a"], folder)
    assert ordered.append(spark.createDataFrame([(2, "x"), (1, None)], SCHEMA), ["a"], folder) == []
    assert sorted((r.row_idx, r.a) for r in ordered.read(spark, folder).collect()) == [(0, 1), (1, 2)]


def test_two_writers_one_wins(spark, tmp_path):
    bind = lambda *rows: spark.createDataFrame(list(rows), "binding_id string, source_query_hash string, param_hash string")
    state = BindingState(spark, str(tmp_path / "s"))
    assert state.version() == -1 and state.read().count() == 0
    seen = []
    assert state.resolve(bind(("a", "q", "p"), ("b", "q", "p")), lambda t: seen.append(t.count())).count() == 2
    other = BindingState(spark, str(tmp_path / "s"))

    def slow(todo):  # another writer commits while this one resolves
        other.resolve(bind(("a", "q2", "p")), lambda t: seen.append(t.count()))

    with pytest.raises(Conflict):
        state.resolve(bind(("b", "q", "p2")), slow)
    now = {tuple(r) for r in state.read().collect()}
    assert now == {("a", "q2", "p"), ("b", "q", "p")} and state.version() == 1
    assert state.resolve(bind(("b", "q", "p2"), ("a", "q2", "p")), lambda t: seen.append(t.count())).count() == 1
    assert {tuple(r) for r in state.read().collect()} == {("a", "q2", "p"), ("b", "q", "p2")} and seen == [2, 1, 1]
    assert {tuple(r) for r in state.read(0).collect()} == {("a", "q", "p"), ("b", "q", "p")}
    # A run that fails commits nothing.
    with pytest.raises(ZeroDivisionError):
        state.resolve(bind(("c", "q", "p")), lambda t: 1 / 0)
    assert state.version() == 2


def test_parts_in_order_are_the_text(spark, tmp_path):
    rng = random.Random(12)
    rows = [(rng.randrange(50), rng.choice(["é x", "", None, "b"])) for _ in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    files.write_ordered_text(df.repartition(5), ["a"], str(tmp_path / "t"), partitions=8)
    parts = sorted((json.loads(x) for f in (tmp_path / "t/manifest").glob("*.json") for x in f.read_text().splitlines()), key=lambda r: r["part"])
    whole = b"".join((tmp_path / "t/parts" / p["file"]).read_bytes() for p in parts)
    want = ["a\tb"] + [f"{a}\t{b or ''}" for a, b in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))]
    assert whole.decode() == "".join(f"{x}\n" for x in want) and len(parts) > 4
    assert [p["offset"] for p in parts] == [sum(q["n_bytes"] for q in parts[:i]) for i in range(len(parts))]
    files.write_ordered_text(df.limit(0), ["a"], str(tmp_path / "e"))
    assert [r.line for r in files.read_text_lines(spark, str(tmp_path / "e")).collect()] == ["a\tb"]
