"""Hash trees, carried revisions and the refresh by complete snapshots."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import revisions, shape, sync
from quire.sources.files import landed_fingerprints
from quire.streaming.refresh import apply_snapshot, land_marker, land_rows, refresh

SCHEMA = "k long, v string"


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), SCHEMA)


def test_ten_deltas_carry_the_hash(spark):
    rng = random.Random(4)
    rows, leaf = {i: f"v{i}" for i in range(300)}, revisions.range_leaf("k", 50)
    leaves = revisions.leaf_hashes(frame(spark, rows), leaf)
    for step in range(10):
        gone = {k: rows[k] for k in rng.sample(sorted(rows), 7)}
        come = {rng.randrange(600): rng.choice(["", "x", None]) for _ in range(9)}
        changed = {k: v for k, v in (rows | come).items() if k in come or k not in gone}
        removed = {k: v for k, v in rows.items() if k in gone or k in come}
        inserted = {k: v for k, v in changed.items() if k in removed or k not in rows}
        rows = {k: v for k, v in rows.items() if k not in removed} | inserted
        leaves = revisions.carried(leaves, frame(spark, removed), frame(spark, inserted), leaf)
        leaves = spark.createDataFrame(leaves.collect(), leaves.schema)
    assert revisions.revision_of(leaves, ["k", "v"]).first() == shape.content_hash(frame(spark, rows)).first()
    assert sorted(leaves.collect()) == sorted(revisions.leaf_hashes(frame(spark, rows), leaf).collect())
    empty = revisions.leaf_hashes(frame(spark, {}), leaf)
    assert revisions.revision_of(empty, ["k", "v"]).first() == shape.content_hash(frame(spark, {})).first()


def test_only_unlike_leaves_are_read(spark, tmp_path):
    old = spark.range(20_000).selectExpr("id AS k", "concat('v', id) AS v").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 'null' AS v"))
    new = old.where("k IS NULL OR k <> 777").withColumn("v", F.when(F.col("k") == 12_345, "other").otherwise(F.col("v"))).unionByName(spark.sql("SELECT 900000L AS k, 'far' AS v"))
    for name, df in (("old", old), ("new", new)):
        revisions.write_revision(df, f"{tmp_path}/{name}", revisions.range_leaf("k", 100))
    trees = [spark.read.parquet(f"{tmp_path}/{n}/tree") for n in ("old", "new")]
    unlike = {r.node: (r.in_old, r.in_new) for r in revisions.unlike_leaves(*trees).collect()}
    assert unlike == {7: (True, True), 123: (True, True), 9000: (False, True)}
    diff = revisions.merkle_diff(spark, f"{tmp_path}/old", f"{tmp_path}/new", SCHEMA, ["k"])
    assert {(r.k, r.change_type) for r in diff.collect()} == {(777, "removed"), (12_345, "updated"), (900_000, "inserted")}
    assert {os.path.basename(os.path.dirname(f)) for f in diff.inputFiles()} == {"leaf=7", "leaf=123", "leaf=9000"}
    assert revisions.merkle_diff(spark, f"{tmp_path}/old", f"{tmp_path}/old", SCHEMA, ["k"]).count() == 0


def test_unchanged_files_are_not_read(spark, tmp_path):
    for i in range(3):
        frame(spark, {i: f"v{i}"}).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    keys = lambda: spark.createDataFrame(landed_fingerprints(spark, f"{tmp_path}/in/*/*.parquet", "u", "parquet").collect(), "path string, key string")
    first = revisions.file_hashes(spark, keys(), SCHEMA)
    last = spark.createDataFrame(first.collect(), first.schema)
    marked = last.withColumn("n", F.lit(100).cast("long"))  # a file that is read again would have 1
    frame(spark, {5: "new"}).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/1")
    again = revisions.file_hashes(spark, keys(), SCHEMA, last=marked)
    assert sorted(r.n for r in again.collect()) == [1, 100, 100]
    again = revisions.file_hashes(spark, keys(), SCHEMA, last=last)
    want = shape.content_hash(frame(spark, {0: "v0", 5: "new", 2: "v2"})).first()
    assert revisions.revision_of(again, ["k", "v"]).first() == want


def changes(spark, state):
    return {(r.batch, r.change_type): r.n for r in spark.read.parquet(f"{state}/changes").collect()}


def test_files_that_land_late_are_not_removed_rows(spark, tmp_path):
    folder, state = f"{tmp_path}/landed", f"{tmp_path}/state"
    rows = {i: f"v{i}" for i in range(40)}
    schema = frame(spark, rows).schema
    run = lambda: refresh(spark, folder, schema, ["k"], state, leaves=8).awaitTermination()
    land_rows(frame(spark, rows), folder, 0)
    land_marker(spark, folder, 0)
    run()
    assert changes(spark, state) == {(0, "inserted"): 40}
    # The second snapshot's first file is there, but not its marker.
    later = {k: v for k, v in rows.items() if k != 3} | {4: "w", 99: "new"}
    land_rows(frame(spark, {k: v for k, v in later.items() if k < 20}), folder, 1)
    run()
    assert changes(spark, state) == {(0, "inserted"): 40}
    land_rows(frame(spark, {k: v for k, v in later.items() if k >= 20}), folder, 1)
    land_marker(spark, folder, 1)
    for k in (2, 3):  # two more complete ones before the next run
        land_rows(frame(spark, later), folder, k)
        land_marker(spark, folder, k)
    run()
    second = {(1, "inserted"): 1, (1, "removed"): 1, (1, "updated"): 1, (1, "unchanged"): 38}
    assert changes(spark, state) == {(0, "inserted"): 40} | second | {(2, "unchanged"): 40, (3, "unchanged"): 40}
    run()
    assert not apply_snapshot(spark, frame(spark, {}), ["k"], state, 2)
    # Only what the last manifests name is left: the first version's leaves that no snapshot changed, and the second's.
    assert sorted(os.listdir(f"{state}/manifest")) == ["v=2", "v=3"] and {"v=0", "v=1"} <= set(os.listdir(f"{state}/rows"))
    assert len(os.listdir(f"{state}/rows/v=1")) - 1 < 8 + 2


def test_a_run_that_broke_off_is_repeated(spark, tmp_path):
    state = f"{tmp_path}/state"
    a, b = frame(spark, {1: "a", 2: "b"}), frame(spark, {1: "a", 2: "c"})
    apply_snapshot(spark, a, ["k"], state, 0, leaves=4)

    def fail(diff, n):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        apply_snapshot(spark, b, ["k"], state, 1, leaves=4, on_change=fail)
    seen = []
    assert apply_snapshot(spark, b, ["k"], state, 1, leaves=4, on_change=lambda d, n: seen.append(Counter(r.change_type for r in d.collect())))
    assert seen[0]["updated"] == 1 and changes(spark, state)[1, "updated"] == 1
    assert sync.diff_summary(sync.row_diff(a, b, ["k"])).count() == 2


def test_rows_in_another_order_are_dealt_by_size(spark):
    """Partitions of the moved rows are cut by their size; no fixed number of tasks reads the whole table."""
    from quire.queries import QUERIES

    query = QUERIES["content_revision"](spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and "RepartitionByExpression" not in plan
    assert tuple(query.first())[2:] == (True, False)
