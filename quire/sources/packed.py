"""Many documents packed into few large files, with an index of where each one is: the data source ``packedDocuments``.

A folder for each document, as in :func:`quire.sources.files.write_documents`, does not survive a million of them. Here each
task writes one file of lines and one index, ``<path>/data/<job>/<name>.jsonl`` and ``.index.parquet``. A job ends with a manifest
``<path>/manifests/<version>.json`` of its files, and only files of the last manifest are read, so a job that was aborted or an
attempt that was lost leaves nothing that a reader sees. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quire.operators.shape import total_order

LINES = "unit string, line string"
INDEX = pa.schema([("unit", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("n_rows", pa.int64())])
#: Index entries kept in memory, and bytes read at once.
ENTRIES = 50_000
CHUNK = 1 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the place in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, which means the same on every executor."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def manifests(fs: pafs.FileSystem, place: str) -> list[str]:
    """The manifests of a place, oldest first."""
    found = fs.get_file_info(pafs.FileSelector(f"{place}/manifests", allow_not_found=True))
    return sorted(i.path for i in found if i.path.endswith(".json"))


def listed(fs: pafs.FileSystem, manifest: str) -> list[Written]:
    with fs.open_input_stream(manifest) as f:
        return [Written(**x) for x in json.loads(f.read())]


@dataclass
class Written(WriterCommitMessage):
    """A file and the labels that it may hold: from ``lo`` to ``hi``, and null."""

    name: str
    part: int
    n_rows: int
    lo: str | None
    hi: str | None
    nulls: bool

    def may_hold(self, label: str | None) -> bool:
        return self.nulls if label is None else self.lo is not None and self.lo <= label <= self.hi


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        """Lines in the order in which they come; lines of one label that follow each other are one entry of the index."""
        fs, place = opened(self.path)
        folder = f"{place}/data/{self.job}"
        fs.create_dir(folder, recursive=True)
        name = f"{self.job}/{uuid.uuid4().hex}"
        file = f"{place}/data/{name}"
        at, n_rows, entries, lo, hi, nulls = 0, 0, [], None, None, False
        try:
            with fs.open_output_stream(f"{file}.jsonl") as out, fs.open_output_stream(f"{file}.index.parquet") as to, pq.ParquetWriter(to, INDEX) as index:
                for batch in iterator:
                    for unit, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        data = line.encode() + b"\n"
                        if entries and entries[-1]["unit"] == unit:
                            entries[-1]["n_bytes"] += len(data)
                            entries[-1]["n_rows"] += 1
                        else:
                            if len(entries) >= ENTRIES:
                                index.write_table(pa.Table.from_pylist(entries, INDEX))
                                entries = []
                            entries.append({"unit": unit, "offset": at, "n_bytes": len(data), "n_rows": 1})
                            if unit is None:
                                nulls = True
                            else:
                                lo, hi = unit if lo is None else min(lo, unit), unit if hi is None else max(hi, unit)
                        out.write(data)
                        at += len(data)
                        n_rows += 1
                index.write_table(pa.Table.from_pylist(entries, INDEX))
        except BaseException:
            for end in (".jsonl", ".index.parquet"):
                if fs.get_file_info(file + end).type != pafs.FileType.NotFound:
                    fs.delete_file(file + end)
            raise
        return Written(name, TaskContext.get().partitionId(), n_rows, lo, hi, nulls)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest, which holds a line for each task, takes its name when it is whole. An overwritten version's files stay for
        readers that have begun; those of versions before it go."""
        fs, place = opened(self.path)
        old = manifests(fs, place)
        mine = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        kept = [] if self.overwrite or not old else listed(fs, old[-1])
        fs.create_dir(f"{place}/manifests", recursive=True)
        version = int(old[-1].rsplit("/", 1)[1][:-5]) + 1 if old else 0
        aside = f"{place}/manifests/.{self.job}"
        with fs.open_output_stream(aside) as out:
            out.write(json.dumps([asdict(m) for m in kept + mine]).encode())
        fs.move(aside, f"{place}/manifests/{version:010d}.json")
        self.clean(fs, place, {m.name for m in mine})
        live = {m.name.split("/")[0] for m in kept + mine} | {m.name.split("/")[0] for o in old[-1:] for m in listed(fs, o)}
        for gone in {m.name.split("/")[0] for o in old[:-1] for m in listed(fs, o)} - live:
            fs.delete_dir(f"{place}/data/{gone}")
        for o in old[:-1]:
            fs.delete_file(o)

    def abort(self, messages: list[Written | None]) -> None:
        fs, place = opened(self.path)
        if fs.get_file_info(f"{place}/data/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{place}/data/{self.job}")

    def clean(self, fs: pafs.FileSystem, place: str, names: set[str]) -> None:
        """Take away what lost attempts of this job have left."""
        for i in fs.get_file_info(pafs.FileSelector(f"{place}/data/{self.job}", allow_not_found=True)):
            if f"{self.job}/{i.base_name.split('.')[0]}" not in names:
                fs.delete_file(i.path)


@dataclass
class Piece(InputPartition):
    """A packed file."""

    name: str
    part: int


class PackedReader(DataSourceReader):
    def __init__(self, path: str, wanted: bool, label: str | None) -> None:
        self.path, self.wanted, self.label = path, wanted, label

    def partitions(self) -> list[Piece]:
        fs, place = opened(self.path)
        now = manifests(fs, place)
        if not now:
            raise FileNotFoundError(f"{self.path} holds no packed documents")
        pieces = [Piece(m.name, i) for i, m in enumerate(listed(fs, now[-1])) if not self.wanted or m.may_hold(self.label)]
        return pieces or [Piece("", -1)]

    def read(self, partition: Piece) -> Iterator[tuple[str | None, str, int, int]]:
        """Only the bytes of wanted entries are read, a chunk at a time."""
        if partition.part < 0:
            return
        fs, place = opened(self.path)
        file = f"{place}/data/{partition.name}"
        index = pads.dataset(f"{file}.index.parquet", format="parquet", filesystem=fs)
        test = None
        if self.wanted:
            test = pads.field("unit").is_null() if self.label is None else pads.field("unit") == self.label
        with fs.open_input_file(f"{file}.jsonl") as data:
            for batch in index.to_batches(filter=test):
                for entry in batch.to_pylist():
                    data.seek(entry["offset"])
                    left, rest, pos = entry["n_bytes"], b"", entry["offset"]
                    while left:
                        got = data.read(min(left, CHUNK))
                        left -= len(got)
                        *lines, rest = (rest + got).split(b"\n")
                        for line in lines:
                            yield entry["unit"], line.decode(), partition.part, pos
                            pos += len(line) + 1


class PackedDocuments(DataSource):
    """``unit, line`` are written; ``unit, line, part, pos`` are read, and ordered by part and position they are in the written order.

    Options: ``path``; ``label`` reads one document, ``nullLabel`` that without a label."""

    @classmethod
    def name(cls) -> str:
        return "packedDocuments"

    def schema(self) -> str:
        return f"{LINES}, part int, pos long"

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader(self.options["path"], "label" in self.options or "nullLabel" in self.options, self.options.get("label"))

    def writer(self, schema: StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], overwrite)


def pack_documents(df: DataFrame, unit: str, keys: list[str], path: str, mode: str = "overwrite", partitions: int | None = None) -> None:
    """Write the rows of ``df`` as documents, one for each value of ``unit``, with rows in the order of ``keys`` and then all other
    columns. A document of any size is spread over tasks by that order. Null labels are a document; an empty table leaves none."""
    spark = df.sparkSession
    spark.dataSource.register(PackedDocuments)
    order = [unit, *(c for c in total_order(df, keys) if c != unit)]
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    lines = ranged.select(F.col(unit).cast("string").alias("unit"), F.to_json(F.struct(*df.columns)).alias("line"))
    lines.write.format("packedDocuments").mode(mode).option("path", qualified(spark, path)).save()


def read_packed(spark: SparkSession, path: str, schema: StructType, label: str | None = None, null_label: bool = False) -> DataFrame:
    """The rows of all documents, or of one, with ``__part, __pos``, by which rows of one document are in order."""
    spark.dataSource.register(PackedDocuments)
    reader = spark.read.format("packedDocuments").option("path", qualified(spark, path))
    if label is not None:
        reader = reader.option("label", label)
    elif null_label:
        reader = reader.option("nullLabel", "true")
    got = reader.load().select(F.from_json("line", schema).alias("x"), F.col("part").alias("__part"), F.col("pos").alias("__pos"))
    return got.select("x.*", "__part", "__pos")
