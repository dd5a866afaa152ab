"""Distributed pagination against a walk, element by element."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.plans.batch import main
from quire.plans.flow import Segments, applied, placed_elements, repeated_headers, run_flow, run_summary
from quire.plans.layout import FlowOptions


def walk(h, lead, room):
    """Frame and y of each element: an element that doesn't fit begins the next frame, under what is repeated on top."""
    frame, used, out = 0, 0, []
    for x, top in zip(h, lead, strict=True):
        if used + x > room:
            frame, used = frame + 1, top
        out.append((frame, used))
        used += x
    return out


def test_step_functions_compose_to_the_walk():
    rng = random.Random(5)
    for _ in range(400):
        room, n = rng.choice([20, 60, 100]), rng.randrange(1, 120)
        h = [rng.choice([0, 1, 5, 16, 39, 130]) for _ in range(n)]
        lead = [rng.choice([0, 16, 32]) if x <= room else 0 for x in h]
        lead = [a if a + x <= room else 0 for a, x in zip(lead, h, strict=True)]
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(rng.randrange(5)))})
        want, frame, used = walk(h, lead, room), 0, 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            assert (frame, used) == ((want[a - 1][0], want[a - 1][1] + h[a - 1]) if a else (0, 0))
            s = Segments(np.array(h[a:b]), np.array(lead[a:b]), np.array([0]), room).summary()
            frame, used = applied(s, frame, used, room)


def test_many_documents_and_ranges(spark):
    rng = random.Random(6)
    rows = [(f"d{d}" if d else None, i, "record", 0, float(rng.choice([1, 7, 20, 39, 75])), 16.0) for d in range(12) for i in range(rng.choice([1, 3, 900]))]
    df = spark.createDataFrame(rows, "unit string, section_ord long, kind string, rec_no long, height_pt double, lead_pt double")
    got = {(r.unit, r.section_ord): (r.frame_no, r.y_pt) for r in placed_elements(df, ["unit"], 60.0).collect()}
    for d in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == d]
        want = walk([r[4] for r in mine], [16.0 if 16.0 + r[4] <= 60 else 0.0 for r in mine], 60.0)
        assert [got[d, r[1]] for r in mine] == want


def test_one_document_in_several_tasks(spark):
    """A document of 300 000 sections; no task holds it all, and every place is that of the walk."""
    n = 300_000
    e = spark.range(n).selectExpr("'one' AS unit", "id AS section_ord", "CASE WHEN id % 3 = 0 THEN 'header' ELSE 'record' END AS kind", "0L AS rec_no", "CAST(CASE WHEN id % 3 = 0 THEN 16 ELSE 1 + id * 7 % 39 END AS DOUBLE) AS height_pt", "CASE WHEN id % 3 = 0 THEN 0D ELSE 16D END AS lead_pt")
    done = placed_elements(e, ["unit"], 400.0).withColumn("task", F.spark_partition_id())
    per = done.groupBy("task").count().collect()
    assert len(per) >= 2 and max(r["count"] for r in per) < 0.6 * n
    h = [16 if i % 3 == 0 else 1 + i * 7 % 39 for i in range(n)]
    want = walk(h, [0 if i % 3 == 0 else 16 for i in range(n)], 400)
    got = [(r.frame_no, r.y_pt) for r in done.orderBy("section_ord").select("frame_no", "y_pt").toLocalIterator()]
    assert got == want


@pytest.mark.parametrize("frames", [None, 2])
def test_records_beyond_the_frames_are_told(spark, frames):
    df = spark.createDataFrame([("a", "k", i, 10.0 + i) for i in range(12)] + [("b", None, 0, 500.0)], "u string, k string, i long, h double")
    placed = run_flow(df, "u", ["k"], 60.0, F.col("h"), F.lit(12.0), frames=frames)
    s = {r.unit: (r.placed, r.total, r.overflow) for r in run_summary(placed).collect()}
    assert s["b"] == (1, 1, False) or frames == 2
    assert s["a"][1] == 12 and s["a"][2] is (frames == 2) and (s["a"][0] == 12) is (frames is None)
    assert placed.where("kind = 'record'").count() == 13
    for r in repeated_headers(placed).collect():
        assert r.y_pt == 0.0 and (r.continued or r.unit == "a")


def test_empty_and_zero(spark):
    df = spark.createDataFrame([], "u string, k string, h double")
    assert run_flow(df, "u", ["k"], 60.0, F.col("h")).count() == 0
    df = spark.createDataFrame([("a", "k", None), ("a", "k", 0.0)], "u string, k string, h double")
    assert [(r.frame_no, r.y_pt) for r in run_flow(df, "u", ["k"], 60.0, F.col("h")).where("kind = 'record'").collect()] == [(0, 16.0), (0, 16.0)]


@pytest.mark.parametrize("mode,labels", [("catalog", {"u0": 7, "u1": 6}), ("group", {"k0": 5, "k1": 4, "": 4}), ("record", {f"n{i}": 1 for i in range(12)} | {"row-0": 1})])
def test_the_entry_tells_labels_and_what_is_left_over(spark, tmp_path, monkeypatch, mode, labels):
    rows = [(f"u{i % 2}" if mode != "group" else "u", f"k{i % 3}" if i % 3 < 2 else None, f"n{i}" if i < 12 else None, i, 30.0) for i in range(13)]
    spark.createDataFrame(rows, "u string, k string, name string, i long, h double").write.parquet(f"{tmp_path}/t")
    job = {"table": f"{tmp_path}/t", "unit": "u", "by": ["k"], "chain": {"height_pt": 80.0, "frames": 2}, "height": "h", "mode": mode, "label": "name", "out": f"{tmp_path}/out"}
    (tmp_path / "job.json").write_text(json.dumps(job))
    monkeypatch.setattr("sys.argv", ["batch", "--job", str(tmp_path / "job.json")])
    main()
    runs = {r.label: r for r in spark.read.json(f"{tmp_path}/out/runs").collect()}
    assert {label: r.total for label, r in runs.items()} == labels
    assert all(r.overflow == (r.placed < r.total) for r in runs.values()) and any(r.overflow for r in runs.values()) == (mode != "record")
    records = spark.read.json(f"{tmp_path}/out/records")
    assert records.count() == sum(r.placed for r in runs.values()) and (mode != "record" or {(r.frame_no, r.y_pt) for r in records.collect()} == {(0, 16.0)})
    # A list of frames reports the same way.
    job |= {"chain": [{"frame": "a", "page": "1", "height_pt": 80.0}], "record_pt": 30.0}
    (tmp_path / "job.json").write_text(json.dumps(job))
    main()
    runs = spark.read.json(f"{tmp_path}/out/runs").collect()
    assert sum(r.total for r in runs) == 13 and any(r.overflow for r in runs) == (mode != "record")
