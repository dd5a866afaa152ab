"""Versioned tables ``<folder>/v=<n>`` of which only those count whose write has ended, and pointers that one writer sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.shape import to_resolve


def file_system(spark: SparkSession, folder: str) -> tuple[object, object]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def committed(spark: SparkSession, folder: str) -> dict[int, object]:
    """The complete versions in a folder and their paths."""
    fs, path = file_system(spark, folder)
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return {int(p.getName()[2:]): p for p in found if p.getName().startswith("v=") and fs.exists(done(p, "_SUCCESS"))}


class Conflict(Exception):
    """Another writer has committed since this one read."""


class BindingState:
    """The stamps of resolved bindings (``binding_id, source_query_hash, param_hash``), in versions.

    A writer reads a version, writes its successor under a name of its own and commits by creating the successor's pointer, which
    the file system lets one writer do; the other gets :class:`Conflict`, reads again and repeats. A reader sees whole versions.
    """

    columns = ("binding_id", "source_query_hash", "param_hash")

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def version(self) -> int:
        """The last committed version, -1 if there is none."""
        fs, path = file_system(self.spark, f"{self.folder}/pointers")
        return max((int(s.getPath().getName()) for s in fs.listStatus(path)), default=-1) if fs.exists(path) else -1

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in self.columns))
        fs, path = file_system(self.spark, f"{self.folder}/pointers/{version}")
        stream = fs.open(path)
        try:
            name = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.schema(", ".join(f"{c} string" for c in self.columns)).parquet(f"{self.folder}/tables/{name}")

    def commit(self, table: DataFrame, after: int) -> int:
        """Make ``table`` the version after ``after``, which it was made from."""
        name = uuid.uuid4().hex
        table.select(*(F.col(c).cast("string").alias(c) for c in self.columns)).write.parquet(f"{self.folder}/tables/{name}")
        fs, path = file_system(self.spark, f"{self.folder}/pointers/{after + 1}")
        fs.mkdirs(path.getParent())
        # The pointer's content is written aside, and its name is taken by a rename, which fails if the name is there.
        _, aside = file_system(self.spark, f"{self.folder}/aside/{name}")
        out = fs.create(aside, False)
        out.write(bytearray(name.encode()))
        out.close()
        if fs.exists(path) or not fs.rename(aside, path):
            fs.delete(aside, False)
            raise Conflict(f"version {after + 1} is another writer's")
        return after + 1

    def resolve(self, wanted: DataFrame, run) -> DataFrame:
        """Call ``run`` with the bindings of ``wanted`` whose stamps are not the state's, and commit their stamps when it returns;
        bindings that are not wanted keep theirs. Returns what was resolved."""
        at = self.version()
        state = self.read(at)
        todo = to_resolve(wanted.select(*self.columns), state).cache()
        try:
            run(todo)
            rest = state.join(todo.select("binding_id"), "binding_id", "left_anti")
            self.commit(rest.select(*self.columns).unionByName(todo.select(*self.columns)), at)
            return to_resolve(self.read(at + 1), state)
        finally:
            todo.unpersist()
