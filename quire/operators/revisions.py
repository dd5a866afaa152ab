"""Revisions kept as ranges of rows with a hash tree beside them.

Rows belong to leaves: ranges of the key, or of its hash. A leaf's hash is additive, a count and two sums of row hashes, so
a delta carries it forward without the leaf's other rows, and all leaves add up to the content hash of the whole. Nodes above hash
their children. Two revisions are compared from the top; only leaves with unlike hashes are read and joined.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.shape import known, row_hash
from quire.operators.sync import row_diff

#: Bits by which a level of the tree is coarser than the one below, and levels.
BITS = 8
LEVELS = 3


def hashed_leaf(key: list[str], leaves: int = 4096) -> Column:
    """Equal shares of the key's hash; for keys that change all over their range."""
    return F.pmod(F.xxhash64(*key), F.lit(leaves))


def range_leaf(key: str, width: int) -> Column:
    """Ranges of ``width`` of a whole-numbered key; for keys that change in places, as appended ones do."""
    return F.floor(F.col(key) / width)


def leaf_hashes(df: DataFrame, leaf: Column | str) -> DataFrame:
    """``leaf, n, s1, s2``: rows and sums of row hashes, in one aggregate with partial sums. Rows without a leaf number are leaf -1."""
    sums = [F.sum(row_hash(df.columns, s).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"s{s}") for s in (1, 2)]
    column = F.col(leaf) if isinstance(leaf, str) else leaf
    return df.groupBy(F.coalesce(column, F.lit(-1)).cast("long").alias("leaf")).agg(F.count("*").alias("n"), *sums)


def carried(leaves: DataFrame, removed: DataFrame, inserted: DataFrame, leaf: Column) -> DataFrame:
    """The leaves after a delta of whole rows; an updated row is one removed and one inserted. Rows that stay are not read."""
    minus = leaf_hashes(removed, leaf).select("leaf", *((-F.col(c)).alias(c) for c in ("n", "s1", "s2")))
    parts = leaves.select("leaf", "n", "s1", "s2").unionByName(minus).unionByName(leaf_hashes(inserted, leaf))
    return parts.groupBy("leaf").agg(F.sum("n").alias("n"), *(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("s1", "s2"))).where("n <> 0")


def revision_of(leaves: DataFrame, columns: list[str]) -> DataFrame:
    """``n_rows, h1, h2, schema_hash`` from leaves: what ``content_hash`` gives for the rows themselves."""
    schema = hashlib.sha256(json.dumps(columns).encode()).hexdigest()[:16]
    total = lambda c: F.coalesce(F.sum(c).cast("decimal(38,0)").cast("string"), F.lit("0"))
    return leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), total("s1").alias("h1"), total("s2").alias("h2")).withColumn("schema_hash", F.lit(schema))


def tree(leaves: DataFrame) -> DataFrame:
    """``level, node, n, hash``: level 0 are leaves, each level above hashes its children, 2**BITS at most, in order."""
    level = leaves.select(F.lit(0).alias("level"), F.col("leaf").alias("node"), "n", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "s1", "s2"))), 256).alias("hash"))
    out = level
    for i in range(1, LEVELS):
        child = F.array_sort(F.collect_list(F.struct("node", "hash")))
        up = level.groupBy(F.shiftright("node", BITS).alias("up")).agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("|", F.transform(child, lambda c: F.concat_ws(":", c.node.cast("string"), c.hash))), 256).alias("hash"))
        level = up.select(F.lit(i).alias("level"), F.col("up").alias("node"), "n", "hash")
        out = out.unionByName(level)
    return out


def unlike_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """``node, in_old, in_new`` of leaves that differ between two trees, found from the top: below nodes that are alike nothing
    is compared."""
    above = None
    for i in range(LEVELS - 1, -1, -1):
        o, n = (t.where(F.col("level") == i).select("node", F.col("hash").alias(f"{side}_hash")) for t, side in ((old, "old"), (new, "new")))
        if above is not None:
            o, n = (x.join(above, F.shiftright("node", BITS) == F.col("__above"), "left_semi") for x in (o, n))
        unlike = o.join(n, "node", "full_outer").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
        above = unlike.select(F.col("node").alias("__above"))
    return unlike.select("node", F.col("old_hash").isNotNull().alias("in_old"), F.col("new_hash").isNotNull().alias("in_new"))


def write_revision(df: DataFrame, folder: str, leaf: Column) -> None:
    """``df`` as files for each leaf under ``<folder>/data`` and its tree under ``<folder>/tree``. Large leaves are several files."""
    kept = df.withColumn("leaf", F.coalesce(leaf, F.lit(-1)).cast("long"))
    kept.hint("rebalance", "leaf").write.mode("overwrite").partitionBy("leaf").parquet(f"{folder}/data")
    spark = df.sparkSession
    back = spark.read.schema(kept.schema).parquet(f"{folder}/data")
    sums = [F.sum(row_hash(df.columns, s).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"s{s}") for s in (1, 2)]
    tree(back.groupBy("leaf").agg(F.count("*").alias("n"), *sums)).write.mode("overwrite").partitionBy("level").parquet(f"{folder}/tree")


def _leaves(spark: SparkSession, folder: str, schema: str, nodes: list[int]) -> DataFrame:
    """The rows of some leaves; no other file is listed or opened."""
    if not nodes:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/data").parquet(*(f"{folder}/data/leaf={n}" for n in nodes))


def merkle_diff(spark: SparkSession, old_folder: str, new_folder: str, schema: str, key: list[str]) -> DataFrame:
    """``key columns, change_type`` of rows that two written revisions don't share: inserted, updated or removed. Both need the
    same leaves. The numbers of unlike leaves reach the driver, to name their files."""
    old, new = (spark.read.parquet(f"{f}/tree") for f in (old_folder, new_folder))
    unlike = unlike_leaves(old, new).collect()
    before, after = _leaves(spark, old_folder, schema, [r.node for r in unlike if r.in_old]), _leaves(spark, new_folder, schema, [r.node for r in unlike if r.in_new])
    known(before, key)
    return row_diff(before, after, key).where("change_type <> 'unchanged'")


def file_hashes(spark: SparkSession, files: DataFrame, schema: str, fmt: str = "parquet", last: DataFrame | None = None) -> DataFrame:
    """``path, key, n, s1, s2`` of landed files (``path, key``): those with the key they had in ``last`` keep its sums and are not
    read. Add them up with :func:`revision_of`. The paths of changed files reach the driver, to be opened."""
    todo = files if last is None else files.join(last.select("path", "key"), ["path", "key"], "left_anti")
    paths = [r.path for r in todo.select("path").collect()]
    columns = spark.createDataFrame([], schema).columns
    sums = [F.sum(row_hash(columns, s).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"s{s}") for s in (1, 2)]
    zero = F.lit(0).cast("decimal(38,0)")
    out = todo.select("path", "key", F.lit(0).cast("long").alias("n"), zero.alias("s1"), zero.alias("s2"))
    if paths:
        rows = spark.read.schema(schema).format(fmt).load(paths).select(*columns, F.col("_metadata.file_path").alias("path"))
        read = rows.groupBy("path").agg(F.count("*").alias("n"), *sums)
        out = todo.join(read, "path", "left").select("path", "key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s1", zero).alias("s1"), F.coalesce("s2", zero).alias("s2"))
    if last is None:
        return out
    return out.unionByName(last.join(files.select("path", "key"), ["path", "key"], "left_semi").select("path", "key", "n", "s1", "s2"))
