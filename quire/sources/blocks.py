"""Keys of landed files of any size: the data source ``fileBlocks`` hashes byte ranges, and a tree of hashes joins them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quire.sources.packed import opened, qualified

#: Bytes of a leaf, leaves of a node, and levels of nodes below the root: 1 PiB a file before the root grows wider.
BLOCK = 1 << 20
FANOUT = 1024
LEVELS = 2


@dataclass
class Range(InputPartition):
    """Blocks ``first`` to ``end`` (not included) of a file of ``n_bytes`` bytes."""

    path: str
    n_bytes: int
    first: int
    end: int


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.block = int(options.get("block", BLOCK))
        self.split = max(1, int(options.get("split", 128 << 20)) // self.block)

    def partitions(self) -> list[Range]:
        """Files are cut at blocks into ranges of about ``split`` bytes. Names that begin with a dot or underscore are left out, as
        Spark does."""
        fs, place = opened(self.path)
        info = fs.get_file_info(place)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(place, recursive=True))
        ranges = []
        for f in found:
            below = f.path[len(place) :].strip("/").split("/")
            if f.is_file and (f is info or not any(p.startswith((".", "_")) for p in below)):
                blocks = max(1, -(-f.size // self.block))
                ranges += [Range(f.path, f.size, b, min(b + self.split, blocks)) for b in range(0, blocks, self.split)]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str, int, int, str]]:
        if partition.first == partition.end:
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.first * self.block)
            for b in range(partition.first, partition.end):
                want = min(self.block, partition.n_bytes - b * self.block)
                data = f.read(want)
                if len(data) != want:
                    raise OSError(f"{partition.path} has changed while it was read")
                yield partition.path, partition.n_bytes, b, hashlib.sha256(data).hexdigest()


class FileBlocks(DataSource):
    """``path, n_bytes, block, digest`` for every block of every file below ``path``. Options: ``block`` and ``split`` in bytes."""

    @classmethod
    def name(cls) -> str:
        return "fileBlocks"

    def schema(self) -> str:
        return "path string, n_bytes long, block long, digest string"

    def reader(self, schema: StructType) -> BlockReader:
        return BlockReader(dict(self.options))


def tree_hashes(spark: SparkSession, path: str, block: int = BLOCK, fanout: int = FANOUT, levels: int = LEVELS, split: int = 128 << 20) -> DataFrame:
    """``path, n_bytes, n_blocks, root`` of each file below ``path``. ``root`` depends on the bytes, ``block``, ``fanout`` and
    ``levels``, not on ``split`` or on which task read what: digests of ``fanout`` neighbours, in order, make their node's.

    An empty file has one empty block. No task holds more than a block or ``fanout`` digests, but for the root of a file of more
    than ``block * fanout ** (levels + 1)`` bytes.
    """
    spark.dataSource.register(FileBlocks)
    leaves = spark.read.format("fileBlocks").option("path", qualified(spark, path)).option("block", str(block)).option("split", str(split)).load()
    nodes = leaves.withColumnsRenamed({"block": "node"}).withColumn("n_blocks", F.lit(1).cast("long"))
    for level in range(levels + 1):
        up = F.lit(0).cast("long") if level == levels else F.floor(F.col("node") / fanout).cast("long")
        parts = F.array_sort(F.collect_list(F.struct("node", "digest")))
        nodes = nodes.groupBy("path", "n_bytes", up.alias("__up")).agg(F.sum("n_blocks").alias("n_blocks"), F.sha2(F.array_join(F.transform(parts, lambda x: x["digest"]), ""), 256).alias("digest")).withColumnRenamed("__up", "node")
    return nodes.select("path", "n_bytes", "n_blocks", F.col("digest").alias("root"))


def tree_fingerprints(spark: SparkSession, folder: str, url: str, fmt: str, params: dict[str, str] | None = None, **tree: int) -> DataFrame:
    """``path, key`` of landed files of any size, as :func:`quire.sources.files.landed_fingerprints` gives for small ones: a hash of
    the descriptor, the length and the content's tree. For :func:`quire.sources.files.changed_files`."""
    descriptor = hashlib.sha256(json.dumps([url, fmt, sorted((params or {}).items())]).encode()).hexdigest()
    return tree_hashes(spark, folder, **tree).select("path", F.sha2(F.concat_ws("|", F.lit(descriptor), F.col("n_bytes").cast("string"), "root"), 256).alias("key"))
