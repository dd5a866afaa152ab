"""Shaping query results: parameters, single records, scalars, groups, a stable order with row numbers, content hashes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ParamDecl:
    """A declared parameter: kind is text, number, bool or date."""

    name: str
    kind: str = "text"
    required: bool = False


def _number(v: object) -> int | float:
    """Whole numbers stay whole: keys beyond 2**53 are exact."""
    if isinstance(v, str):
        return int(v) if v.strip().lstrip("+-").isdigit() else float(v)
    return v if isinstance(v, (int, float)) and not isinstance(v, bool) else float(v)


def _bool(v: object) -> bool:
    known = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False, "": False}
    if isinstance(v, str) and v.strip().lower() not in known:
        raise ValueError(f"not a boolean: {v!r}")
    return known[v.strip().lower()] if isinstance(v, str) else bool(v)


_CASTS = {"text": str, "number": _number, "bool": _bool, "date": lambda v: v if isinstance(v, date) else date.fromisoformat(v)}


def parameterised(spark: SparkSession, sql: str, decls: list[ParamDecl], params: dict[str, object]) -> DataFrame:
    """SQL over named tables with typed ``:name`` parameters; a required one that is missing is an error, others are null."""
    missing = [d.name for d in decls if d.required and params.get(d.name) is None]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    return spark.sql(sql, args={d.name: None if params.get(d.name) is None else _CASTS[d.kind](params[d.name]) for d in decls})


def known(df: DataFrame, keys: list[str]) -> list[str]:
    """Unknown columns are an error when the plan is built."""
    unknown = [k for k in keys if k not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return keys


def total_order(df: DataFrame, keys: list[str]) -> list[str]:
    """The keys and then all other columns, so that the order doesn't depend on the rows' delivery."""
    return known(df, keys) + [c for c in df.columns if c not in keys]


def nth_record(df: DataFrame, keys: list[str], n: int = 0) -> DataFrame:
    """Record n (from 0) in the stable order, or no row: a top-k, not a full sort."""
    return df.orderBy(*total_order(df, keys)).limit(n + 1).orderBy(*total_order(df, keys)).offset(n)


def single_record(df: DataFrame, keys: list[str]) -> DataFrame:
    return nth_record(df, keys, 0)


def scalar(df: DataFrame, keys: list[str], column: str | None = None) -> DataFrame:
    """One row: the first record's value (``value``), null if there is no record."""
    first = single_record(df, keys).select(F.col(column or df.columns[0]).alias("value"))
    return first.agg(F.first("value").alias("value"))


def stable_index(df: DataFrame, keys: list[str], out: str = "row_idx", partitions: int | None = None) -> DataFrame:
    """Rows in the total order with their number from 0, without a single-partition sort.

    Rows are dealt by ranges of the order and sorted within partitions; numbers are places in a partition plus the counts
    of the partitions before it. Equal rows are interchangeable. The ranged rows are checkpointed, since range bounds
    are sampled anew on each run.
    """
    order = total_order(df, keys)
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    # The low 33 bits of the id are the place in the partition, the bits above the partition.
    numbered = ranged.withColumn("__id", F.monotonically_increasing_id())
    numbered = _cut(numbered)
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return numbered.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(out, place + F.col("__before")).drop("__part", "__before", "__id")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for intermediate tables; a local master without one gets the warehouse's."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quire-checkpoint"
    return folder.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def grouped(df: DataFrame, keys: list[str], idx: str = "row_idx") -> DataFrame:
    """One row for each key: ``n`` and ``first_seen``, the smallest row number. Members stay a long table."""
    return df.groupBy(*known(df, keys)).agg(F.count("*").alias("n"), F.min(idx).alias("first_seen"))


def row_hash(columns: list[str], seed: int) -> Column:
    """64 bits of a row; nulls are told from values, and columns from each other."""
    tagged = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(seed), *tagged)


def content_hash(df: DataFrame, ordered_by: str | None = None) -> DataFrame:
    """One row ``n_rows, h1, h2, schema_hash``: equal if and only if (128 bits) the rows are equal, in any order.

    Row hashes are added up, so that duplicates count, in one aggregate with partial sums. ``ordered_by`` names a row number
    that is to count as content: then the order matters.
    """
    columns = [c for c in df.columns]
    schema = hashlib.sha256(json.dumps([c for c in columns if c != ordered_by]).encode()).hexdigest()[:16]
    h1, h2 = (F.sum(row_hash(columns, s).cast("decimal(38,0)")).cast("string") for s in (1, 2))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(h1, F.lit("0")).alias("h1"), F.coalesce(h2, F.lit("0")).alias("h2")).withColumn("schema_hash", F.lit(schema))


def query_hash(sql: str, shape: str) -> str:
    return hashlib.sha256(f"{shape}\x00{sql}".encode()).hexdigest()


def param_hash(params: dict[str, object]) -> str:
    """Independent of the parameters' order; types are told apart."""
    return hashlib.sha256(json.dumps(sorted((k, type(v).__name__, str(v)) for k, v in params.items())).encode()).hexdigest()


def to_resolve(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """Bindings (``binding_id, source_query_hash, param_hash``) whose stamp isn't the one in the state table."""
    keys = ["binding_id", "source_query_hash", "param_hash"]
    return wanted.join(state.select(*keys), keys, "left_anti")
