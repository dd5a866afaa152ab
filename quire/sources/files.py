"""Sources and sinks: files, seeds, databases, landed-file fingerprints, source inventory, origin and URL checks."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.shape import total_order


def read_file(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None = None, name: str | None = None) -> DataFrame:
    """A CSV, TSV, JSON or Parquet source, as a view if a name is given. Types of text formats are detected without a schema."""
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt in ("csv", "tsv"):
        df = reader.csv(path, header=True, sep="," if fmt == "csv" else "\t", inferSchema=schema is None)
    elif fmt == "json":
        df = reader.json(path)
    elif fmt == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    if name:
        df.createOrReplaceTempView(name)
    return df


def seed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A lookup table carried with a recipe; being given as literals it is small, and joins broadcast it."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def read_database(spark: SparkSession, target: str, table: str, credential_ref: str | None = None, **partitioning: object) -> DataFrame:
    """A database table through JDBC. ``credential_ref`` names environment variables ``<ref>_USER`` and ``<ref>_PASSWORD``;
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` make the read parallel."""
    reader = spark.read.format("jdbc").option("url", target).option("dbtable", table).options(**partitioning)
    if credential_ref:
        reader = reader.options(user=os.environ[f"{credential_ref}_USER"], password=os.environ[f"{credential_ref}_PASSWORD"])
    return reader.load()


def governed_extract(spark: SparkSession, path: str, fmt: str, sidecar_path: str) -> tuple[DataFrame, DataFrame]:
    """A table and its JSON documentation."""
    return read_file(spark, path, fmt), spark.read.json(sidecar_path, multiLine=True)


def landed_fingerprints(spark: SparkSession, folder: str, url: str, fmt: str, params: dict[str, str] | None = None, whole: bool = True) -> DataFrame:
    """``path, key`` of landed files: a hash of the descriptor and of the content. Spark does not read
    files over 2 GB as one value: :func:`quire.sources.blocks.tree_fingerprints` hashes those, and ``whole=False`` only their path,
    length and time."""
    descriptor = hashlib.sha256(json.dumps([url, fmt, sorted((params or {}).items())]).encode()).hexdigest()
    files = spark.read.format("binaryFile").load(folder)
    content = F.sha2("content", 256) if whole else F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")), 256)
    return files.select("path", F.sha2(F.concat_ws("|", F.lit(descriptor), content), 256).alias("key"))


def changed_files(now: DataFrame, last: DataFrame) -> DataFrame:
    """Files whose key the last run has not seen: only these are resolved again."""
    return now.join(last.select("path", "key"), ["path", "key"], "left_anti")


def redacted(target: Column) -> Column:
    """A database or web address without user and password."""
    return F.regexp_replace(target, r"^([^:/?#]+://)[^/?#]*@", "$1")


def inventory(sources: DataFrame) -> DataFrame:
    """``id, kind, capability, origin, target, credential_redacted`` from descriptors ``id, kind, target, db``.

    What a source needs: nothing, a file import, the network, or the network with a credential. SQLite is a file, and an
    extract is remote if its place is a web address. Remote sources show their origin only, databases no credentials.
    """
    kind, target = F.col("kind"), F.coalesce("target", F.lit(""))
    web = target.rlike("^https?://")
    capability = (
        F.when(kind == "inline", "none").when(kind == "file", "fileImport").when(kind == "remote", "network")
        .when(kind == "dbAttach", F.when(F.col("db") == "sqlite", "fileImport").otherwise("networkCredential"))
        .when(kind == "governedExtract", F.when(web, "network").otherwise("fileImport")).otherwise("none")
    )
    origin = F.when(capability.startswith("network"), origin_of(target))
    shown = F.when(kind == "remote", F.coalesce(origin_of(target), target)).when(kind == "dbAttach", redacted(target)).when(kind == "inline", F.concat(F.lit("inline:"), target)).otherwise(target)
    return sources.select("id", "kind", capability.alias("capability"), origin.alias("origin"), shown.alias("target"), (kind == "dbAttach").alias("credential_redacted"))


def origin_of(url: Column) -> Column:
    """``scheme://host[:port]`` in lower case and without user info; null if there is no scheme or host."""
    text = F.regexp_extract(redacted(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(text != "", F.lower(text))


def authorised(rows: DataFrame, url_col: str, consented: DataFrame) -> DataFrame:
    """``rows`` with ``origin, allowed, reason`` against a consented list (``origin``), which is distinct and checked for size
    by the optimiser before it is broadcast."""
    allow = consented.select(F.lower("origin").alias("__allowed")).distinct()
    marked = rows.withColumn("origin", origin_of(F.col(url_col))).join(allow, F.col("origin") == F.col("__allowed"), "left")
    ok = F.col("__allowed").isNotNull()
    return marked.withColumn("allowed", ok).withColumn("reason", F.when(F.col("origin").isNull(), "noOrigin").when(ok, "consented").otherwise("notConsented")).drop("__allowed")


def url_reason(url: Column) -> Column:
    """ok, or why a URL is not fetched: empty, noScheme, badScheme, emptyHost, embeddedCredentials."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1)
    host = F.regexp_extract(authority, r"^(?:.*@)?([^:]*)", 1)
    return (
        F.when(url.isNull() | (url == ""), "empty").when(scheme == "", "noScheme").when(~scheme.isin("http", "https"), "badScheme")
        .when(authority.contains("@"), "embeddedCredentials").when(host == "", "emptyHost").otherwise("ok")
    )


def write_documents(df: DataFrame, unit: str, path: str, fmt: str = "json") -> None:
    """One folder of output for each document, written by the executors; a large document is several files of several tasks. A
    hash of the label keeps folder names safe."""
    df.withColumn("unit_hash", F.sha2(F.col(unit).cast("string"), 256)).hint("rebalance", "unit_hash").write.partitionBy("unit_hash").mode("overwrite").format(fmt).save(path)


def write_text_table(df: DataFrame, path: str, header: bool = True) -> None:
    """Tabs within rows, line feeds between them."""
    df.write.mode("overwrite").option("emptyValue", "").csv(path, sep="\t", header=header)


def write_ordered_text(df: DataFrame, keys: list[str], path: str, columns: list[str] | None = None, header: bool = True, partitions: int | None = None) -> None:
    """``df`` as text in the order of ``keys`` and then all other columns: tabs within rows, line feeds between them, nulls empty.

    Parts under ``<path>/parts``, one after the other by their numbers, are the text; the header stands once, in the first one.
    ``<path>/manifest`` tells of each part ``part, file, n_bytes, offset``: where its bytes are in the whole. Cells are written as
    they are, tabs and line feeds in them too.
    """
    shown = columns or df.columns
    order = total_order(df, keys)
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shown))
    rows = df.select(F.lit(1).alias("__row"), *order, line.alias("__line"))
    if header:
        first = df.sparkSession.range(1).select(F.lit(0).alias("__row"), *(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order), F.lit("\t".join(shown)).alias("__line"))
        rows = rows.unionByName(first)
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), "__row", *order).sortWithinPartitions("__row", *order)
    ranged.select(F.col("__line").alias("value")).write.mode("overwrite").text(f"{path}/parts")
    # A row for each part.
    files = df.sparkSession.read.format("binaryFile").load(f"{path}/parts").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"))
    parts = files.withColumn("part", F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = parts.select("part", "file", "n_bytes", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("offset"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``part, line`` of a text from :func:`write_ordered_text`; within a part lines are read in any order."""
    lines = spark.read.text(f"{path}/parts")
    return lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long").alias("part"), F.col("value").alias("line"))
