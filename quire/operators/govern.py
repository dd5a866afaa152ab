"""Governance: column catalogues enriched from a sidecar, drift between documentation and data, dataset publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.fx import kind_of
from quire.operators.shape import content_hash

# The names of field types in documentation.
TYPE_NAMES = {"num": "float", "int": "int", "bool": "bool", "text": "text", "date": "date", "time": "datetime", "bytes": "bytes", "null": "null"}


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, ord, name, data_type`` of the live columns; only schemas are read."""
    rows = [(t, i, f.name, TYPE_NAMES[kind_of(f.dataType)]) for t, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, ord int, name string, data_type string")


def governed_columns(catalog: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Live columns with label, description and provenance of the sidecar (``table_name, name, label, description, data_type,
    provenance``). The live type wins; the label falls back to the name."""
    s = sidecar.select("table_name", "name", "label", "description", "provenance", F.lit(True).alias("__known"))
    both = catalog.join(F.broadcast(s), ["table_name", "name"], "left")
    return both.select("table_name", "ord", "name", "data_type", F.coalesce("label", "name").alias("label"), "description", "provenance", F.col("__known").isNotNull().alias("documented"))


def drift(catalog: DataFrame, sidecar: DataFrame) -> DataFrame:
    """``table_name, name, diagnostic, documented, actual``: undocumentedColumn, missingColumn, typeMismatch."""
    s = sidecar.select(F.col("table_name").alias("s_table"), F.col("name").alias("s_name"), F.col("data_type").alias("documented"))
    both = catalog.join(s, (F.col("table_name") == F.col("s_table")) & (F.col("name") == F.col("s_name")), "full_outer")
    what = F.when(F.col("s_name").isNull(), "undocumentedColumn").when(F.col("name").isNull(), "missingColumn").when(F.col("documented").isNotNull() & (F.col("documented") != F.col("data_type")), "typeMismatch")
    return both.select(F.coalesce("table_name", "s_table").alias("table_name"), F.coalesce("name", "s_name").alias("name"), what.alias("diagnostic"), "documented", F.col("data_type").alias("actual")).where("diagnostic is not null")


def revision(df: DataFrame) -> str:
    """The content revision of a dataset: it moves if and only if the rows change, in whatever order they come."""
    h = content_hash(df).first()
    return f"{h['n_rows']}-{h['schema_hash']}-{int(h['h1']) & (2**64 - 1):016x}{int(h['h2']) & (2**64 - 1):016x}"


def publish(df: DataFrame, root: str, dataset_id: str, category: str) -> tuple[str, bool]:
    """Write the dataset under ``rev=<revision>`` with a one-row manifest; nothing is written if that revision is there."""
    spark = df.sparkSession
    rev = revision(df)
    base = f"{root}/{dataset_id}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/rev={rev}/_SUCCESS")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return rev, False
    df.sort(*df.columns).write.mode("overwrite").parquet(f"{base}/rev={rev}")
    row = [(dataset_id, category, rev, int(rev.split("-")[0]), df.schema.json())]
    spark.createDataFrame(row, "id string, category string, revision string, row_count long, schema string").write.mode("overwrite").json(f"{base}/manifest")
    return rev, True


def column_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, name, n_filled``: values of each live column that are not null, one aggregate for each table."""
    parts = []
    for t, df in tables.items():
        pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
        parts.append(df.agg(*(F.count(F.col(c)).alias(c) for c in df.columns)).selectExpr(f"'{t}' AS table_name", f"stack({len(df.columns)}, {pairs}) AS (name, n_filled)"))
    return reduce(DataFrame.unionByName, parts)
