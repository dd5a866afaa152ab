"""Scheduled refresh: complete snapshots are taken from a stream of markers and compared with a keyed state.

A snapshot lands as any number of files under its id; the marker that names the id comes last, and only then is it read. So
files that land late, or a snapshot spread over many batches, never look like removed rows.

The state holds a hash for each key, in leaves of the key's hash, and for each leaf its additive hash and the version that wrote
it. A snapshot's leaves are compared first; only unlike ones are joined and written again. A state's manifest is written last:
what it doesn't name doesn't count, so a run that broke off is repeated as if it had not begun.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quire.operators.revisions import hashed_leaf, leaf_hashes
from quire.operators.shape import row_hash
from quire.operators.sync import diff_summary, row_diff
from quire.streaming.state import committed, file_system

_MANIFEST = "leaf long, n long, s1 decimal(38,0), s2 decimal(38,0), version long"


def trigger_of(policy: str, seconds: int | None = None) -> dict[str, object]:
    """The trigger of a refresh policy: manual and onOpen run once over what has landed, interval runs every ``seconds``."""
    if policy == "interval":
        return {"processingTime": f"{seconds} seconds"}
    if policy in ("manual", "onOpen"):
        return {"availableNow": True}
    raise ValueError(f"no refresh for policy {policy}")


def land_rows(df: DataFrame, folder: str, snapshot: int) -> None:
    """Add files to a snapshot; ids grow."""
    df.write.mode("append").parquet(f"{folder}/rows/snapshot={snapshot}")


def land_marker(spark: SparkSession, folder: str, snapshot: int) -> None:
    """Tell that a snapshot is complete."""
    spark.range(1).select(F.lit(str(snapshot)).alias("value")).coalesce(1).write.mode("append").text(f"{folder}/complete")


def apply_snapshot(spark: SparkSession, rows: DataFrame, key: list[str], state: str, snapshot: int, leaves: int = 256, keep: int = 2, on_change: Callable[[DataFrame, int], None] | None = None) -> bool:
    """Compare a snapshot with the state and make it the state; false if it or a later one has been applied.

    ``<state>/changes/batch=<id>`` gets ``change_type, n``; rows of leaves that are alike count as unchanged and are not joined.
    Keys compare null-safely. Of a repeated key the state's largest hash counts. Versions that the last ``keep`` manifests don't
    name are deleted.
    """
    applied = committed(spark, f"{state}/manifest")
    if applied and max(applied) >= snapshot:
        return False
    last = spark.read.schema(_MANIFEST).parquet(f"{state}/manifest/v={max(applied)}") if applied else spark.createDataFrame([], _MANIFEST)
    now = leaf_hashes(rows, hashed_leaf(key, leaves))
    was = last.select("leaf", *(F.col(c).alias(f"was_{c}") for c in ("n", "s1", "s2", "version")))
    same = F.col("n").eqNullSafe(F.col("was_n")) & F.col("s1").eqNullSafe(F.col("was_s1")) & F.col("s2").eqNullSafe(F.col("was_s2"))
    every = now.join(was, "leaf", "full_outer").withColumn("same", same).collect()  # a row for each leaf
    unlike = [r for r in every if not r["same"]]
    kept = spark.createDataFrame([(r["leaf"], r["n"], r["s1"], r["s2"], r["was_version"] if r["same"] else snapshot) for r in every if r["n"]], _MANIFEST)
    hashes = [row_hash(rows.columns, s).alias(f"h{s}") for s in (1, 2)]
    fresh = rows.withColumn("__leaf", hashed_leaf(key, leaves)).where(F.col("__leaf").isin([r["leaf"] for r in unlike])).select(*key, *hashes, "__leaf")
    fresh.hint("rebalance", "__leaf").write.mode("overwrite").partitionBy("__leaf").parquet(f"{state}/rows/v={snapshot}")
    shape = fresh.drop("__leaf").schema
    new = spark.read.schema(shape).parquet(f"{state}/rows/v={snapshot}").select(*shape.names)
    held = [f"{state}/rows/v={r['was_version']}/__leaf={r['leaf']}" for r in unlike if r["was_version"] is not None]
    old = spark.read.schema(shape).parquet(*held) if held else spark.createDataFrame([], shape)
    diff = row_diff(old, new, key)
    alike = sum(r["n"] for r in every if r["same"])
    summary = diff_summary(diff)
    if alike:
        summary = summary.unionByName(spark.createDataFrame([("unchanged", alike)], "change_type string, n long")).groupBy("change_type").agg(F.sum("n").alias("n"))
    summary.coalesce(1).write.mode("overwrite").parquet(f"{state}/changes/batch={snapshot}")
    if on_change:
        on_change(diff, snapshot)
    kept.coalesce(1).write.mode("overwrite").parquet(f"{state}/manifest/v={snapshot}")
    prune(spark, state, keep)
    return True


def prune(spark: SparkSession, state: str, keep: int) -> None:
    """Delete all manifests but the last ``keep`` and the versions of rows that none of those names."""
    fs, _ = file_system(spark, state)
    manifests = committed(spark, f"{state}/manifest")
    stay = sorted(manifests)[-keep:]
    named = {r["version"] for r in spark.read.schema(_MANIFEST).parquet(*(f"{state}/manifest/v={v}" for v in stay)).select("version").distinct().collect()}
    for v in sorted(set(manifests) - set(stay)):
        fs.delete(manifests[v], True)
    rows = committed(spark, f"{state}/rows")
    for v in sorted(set(rows) - named - set(stay)):
        fs.delete(rows[v], True)


def refresh(spark: SparkSession, folder: str, schema: StructType, key: list[str], state: str, policy: str = "onOpen", seconds: int | None = None, on_change: Callable[[DataFrame, int], None] | None = None, leaves: int = 256, keep: int = 2) -> StreamingQuery:
    """Start the refresh of what lands in ``folder`` (:func:`land_rows`, then :func:`land_marker`). Markers are a stream; each complete
    snapshot is applied once, in the order of ids, however markers fall into batches and whenever a run is started again."""
    stream = spark.readStream.schema("value string").format("text").load(f"{folder}/complete")

    def take(batch: DataFrame, _: int) -> None:
        for snapshot in sorted(int(r["value"]) for r in batch.distinct().collect()):
            apply_snapshot(spark, spark.read.schema(schema).parquet(f"{folder}/rows/snapshot={snapshot}"), key, state, snapshot, leaves, keep, on_change)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{state}/checkpoint").trigger(**trigger_of(policy, seconds)).start()
