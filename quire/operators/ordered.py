"""A stable order that is kept under appends: ranges of the order with their bounds and counts.

A row's number is its place in its range plus the counts of the ranges before it. Appended rows find their ranges by the bounds; only
ranges that get rows are read and written again, and split where they have grown; all others are renumbered by their offset
alone, without being read. A manifest names the ranges that count; it is written last.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType, StringType, StructType

from quire.operators.shape import total_order
from quire.streaming.state import committed

_PLACES = (1 << 33) - 1
#: Up to so many ranges have the rows that are asked for; of larger tables both the ranges and their rows grow with the square root.
_RANGES = 100


def _rows(total: int, rows_per_range: int) -> int:
    """Rows of a range of a table of ``total`` rows. Bounds are found from a sample that the driver takes for each range, and each is
    a folder whose files the driver lists, so the number of ranges must not grow as the rows do."""
    return math.ceil(rows_per_range * max(1.0, math.sqrt(total / rows_per_range / _RANGES)))


def _write(rows: DataFrame, order: list[str], folder: str, version: int, parts: int) -> DataFrame:
    """Rows (with ``__old``, the range they were in) as new ranges of ``version``; returns their manifest rows."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("__id", F.monotonically_increasing_id())
    placed = numbered.withColumns({"range": F.concat_ws("-", F.lit(str(version)), F.shiftright("__id", 33).cast("string"), "__old"), "__place": F.col("__id").bitwiseAND(_PLACES)}).drop("__id", "__old")
    placed.write.mode("overwrite").partitionBy("range").parquet(f"{folder}/rows/v={version}")
    back = spark.read.schema(placed.schema).parquet(f"{folder}/rows/v={version}").select(*placed.columns)
    return back.groupBy("range").agg(F.lit(version).cast("long").alias("version"), F.count("*").alias("n"), F.min("__place").alias("first"), F.max(F.struct(*order)).alias("top"))


def _manifest(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    version = max(committed(spark, f"{folder}/manifest"))
    return version, spark.read.parquet(f"{folder}/manifest/v={version}")


def create(df: DataFrame, keys: list[str], folder: str, rows_per_range: int = 1_000_000) -> None:
    """Write ``df`` in the order of ``keys`` and then all other columns. Beyond ``_RANGES`` ranges ``rows_per_range`` is the least."""
    order = total_order(df, keys)
    total = df.count()
    new = _write(df.withColumn("__old", F.lit("new")), order, folder, 0, max(1, math.ceil(total / _rows(total, rows_per_range))))
    new.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v=0")


def _located(df: DataFrame, order: list[str], ranges: DataFrame) -> DataFrame:
    """``df`` with ``range``: the first whose top is not below the row, or the last one. A binary search over all tops, which are
    one row; it grows with the ranges, not with their rows."""
    bounds = ranges.agg(F.array_sort(F.collect_list(F.struct("top", "range"))).alias("__bounds"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(F.lit(2), F.size("__bounds")))).cast("int") + 1)
    me = F.struct(*order)

    def narrowed(s, _):
        middle = F.floor((s.lo + s.hi) / 2).cast("int")
        below = F.get("__bounds", middle).top < F.col("__me")
        return F.when(s.lo >= s.hi, s).otherwise(F.struct(F.when(below, middle + 1).otherwise(s.lo).alias("lo"), F.when(below, s.hi).otherwise(middle).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), (F.size("__bounds") - 1).alias("hi"))
    found = df.withColumn("__me", me).crossJoin(F.broadcast(bounds)).withColumn("range", F.get("__bounds", F.aggregate(steps, start, narrowed).lo).range)
    return found.drop("__me", "__bounds")


def append(df: DataFrame, keys: list[str], folder: str, rows_per_range: int = 1_000_000) -> list[str]:
    """Add rows to what :func:`create` wrote; returns the ranges that were read and replaced. Equal rows are interchangeable. Names of
    touched ranges reach the driver, to name their files."""
    spark, order = df.sparkSession, total_order(df, keys)
    version, ranges = _manifest(spark, folder)
    if ranges.isEmpty():
        create(df, keys, folder, rows_per_range)
        return []
    new = _located(df, order, ranges).select(*df.columns, F.col("range").alias("__old"))
    gets = {r["__old"]: r["n"] for r in new.groupBy("__old").agg(F.count("*").alias("n")).collect()}
    every = ranges.select("range", "version", "n").collect()
    touched = [r for r in every if r["range"] in gets]
    if not touched:
        return []
    size = sum(gets.values()) + sum(r["n"] for r in touched)
    schema = StructType([*df.schema.fields]).add("__place", LongType())
    held = spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(*(f"{folder}/rows/v={r['version']}/range={r['range']}" for r in touched))
    old = held.select(*df.columns, F.col("range").cast(StringType()).alias("__old"))
    per_range = _rows(sum(gets.values()) + sum(r["n"] for r in every), rows_per_range)
    fresh = _write(old.unionByName(new), order, folder, version + 1, max(1, math.ceil(size / per_range)))
    kept = ranges.where(~F.col("range").isin(list(gets)))
    kept.select(*fresh.columns).unionByName(fresh).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v={version + 1}")
    return [r["range"] for r in touched]


def read(spark: SparkSession, folder: str, out: str = "row_idx") -> DataFrame:
    """All rows with their number from 0."""
    _, ranges = _manifest(spark, folder)
    before = Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = ranges.select("range", "version", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__offset"))
    rows = spark.read.parquet(f"{folder}/rows").withColumnRenamed("v", "version")
    return rows.join(F.broadcast(offsets), ["range", "version"]).withColumn(out, F.col("__place") + F.col("__offset")).drop("range", "version", "__place", "__offset")
