"""Packed documents and trees of file hashes: round trips, lost and aborted jobs, any split of a file."""

import hashlib
import os
import random

import pyarrow.dataset as pads
import pytest
from pyspark.sql import functions as F

from quire.sources import blocks, files, packed

ROWS = [("a", 1, "x\ny"), ("a", 2, "ü\t "), (None, 3, "no label"), ("", 4, "empty label"), ("b/../c", 5, None), ("a", 6, ""), ("a", 1, "x\ny")]
SCHEMA = "unit string, n int, t string"


def rows_of(df):
    return [tuple(r)[:-2] for r in df.orderBy("__part", "__pos").collect()]


def kept_files(root):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names)


def test_packed_round_trip_and_labels(spark, tmp_path):
    df, path = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "p")
    packed.pack_documents(df, "unit", ["n"], path, partitions=3)
    assert sorted(rows_of(packed.read_packed(spark, path, df.schema)), key=str) == sorted(ROWS, key=str)
    # A label's rows come whole and in order; a repeated row stays twice.
    assert rows_of(packed.read_packed(spark, path, df.schema, "a")) == [("a", 1, "x\ny"), ("a", 1, "x\ny"), ("a", 2, "ü\t "), ("a", 6, "")]
    assert rows_of(packed.read_packed(spark, path, df.schema, "")) == [("", 4, "empty label")]
    assert rows_of(packed.read_packed(spark, path, df.schema, "b/../c")) == [("b/../c", 5, None)]
    assert rows_of(packed.read_packed(spark, path, df.schema, null_label=True)) == [(None, 3, "no label")]
    assert rows_of(packed.read_packed(spark, path, df.schema, "zzz")) == []


def test_packed_many_documents_are_few_files(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("unit"), "id")
    packed.pack_documents(df, "unit", ["id"], path, partitions=6)
    assert len(kept_files(f"{path}/data")) <= 12 + 12  # a file and an index a task, and their checksums if any
    reader = packed.PackedReader(path, True, "4711")
    assert len(reader.partitions()) <= 2
    assert [r.id for r in packed.read_packed(spark, path, df.schema, "4711").orderBy("__part", "__pos").collect()] == [4711, 9711, 14711, 19711]


def test_packed_hot_document_is_spread(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(9000).select(F.lit("hot").alias("unit"), "id")
    packed.pack_documents(df, "unit", ["id"], path, partitions=4)
    got = packed.read_packed(spark, path, df.schema, "hot")
    assert got.select("__part").distinct().count() > 1
    assert [r.id for r in got.orderBy("__part", "__pos").collect()] == list(range(9000))


def test_packed_overwrite_append_empty(spark, tmp_path):
    df, path = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "p")
    packed.pack_documents(df, "unit", ["n"], path)
    packed.pack_documents(df.where("n = 5"), "unit", ["n"], path, mode="append")
    assert packed.read_packed(spark, path, df.schema).count() == len(ROWS) + 1
    for _ in range(3):
        packed.pack_documents(df.where("n = 4"), "unit", ["n"], path)
    assert rows_of(packed.read_packed(spark, path, df.schema)) == [("", 4, "empty label")]
    jobs = os.listdir(f"{path}/data")
    assert len(jobs) <= 2 and len(os.listdir(f"{path}/manifests")) <= 2
    packed.pack_documents(df.where("false"), "unit", ["n"], path)
    assert rows_of(packed.read_packed(spark, path, df.schema)) == []


def test_packed_abort_leaves_nothing(spark, tmp_path):
    df, path = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "p")
    packed.pack_documents(df.where("n = 4"), "unit", ["n"], path)
    before = kept_files(path)
    bad = spark.range(2000).select(F.col("id").cast("string").alias("unit"), F.when(F.col("id") == 1999, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("t"))
    with pytest.raises(Exception, match="stop"):
        packed.pack_documents(bad, "unit", ["t"], path, partitions=4)
    # A task that fails after others have ended, in the writer itself.
    lines = spark.range(0, 4000, 1, 4).select(F.col("id").cast("string").alias("unit"), F.when(F.col("id") == 3999, F.raise_error(F.lit("late"))).otherwise(F.lit("{}")).alias("line"))
    with pytest.raises(Exception, match="late"):
        lines.write.format("packedDocuments").mode("append").option("path", packed.qualified(spark, path)).save()
    assert kept_files(path) == before
    assert rows_of(packed.read_packed(spark, path, df.schema)) == [("", 4, "empty label")]


def test_packed_lost_attempt_is_not_read(spark, tmp_path):
    """What an attempt left behind is in no manifest, and goes when its job ends."""
    df, path = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "p")
    packed.pack_documents(df, "unit", ["n"], path)
    w = packed.PackedWriter(path, False)
    os.makedirs(f"{path}/data/{w.job}")
    for name in ("lost.jsonl", "lost.index.parquet", "won.jsonl", "won.index.parquet"):
        open(f"{path}/data/{w.job}/{name}", "w").close()
    assert packed.read_packed(spark, path, df.schema).count() == len(ROWS)
    w.commit([packed.Written(f"{w.job}/won", 0, 0, None, None, False), None])
    assert sorted(os.listdir(f"{path}/data/{w.job}")) == ["won.index.parquet", "won.jsonl"]


def test_packed_index_tells_every_byte(spark, tmp_path):
    path = str(tmp_path / "p")
    packed.pack_documents(spark.createDataFrame(ROWS, SCHEMA), "unit", ["n"], path, partitions=2)
    for f in kept_files(f"{path}/data"):
        if f.endswith(".index.parquet"):
            entries = pads.dataset(f).to_table().to_pylist()
            assert sum(e["n_bytes"] for e in entries) == os.path.getsize(f.replace(".index.parquet", ".jsonl"))


def plain_tree(data: bytes, block: int, fanout: int, levels: int) -> str:
    level = [hashlib.sha256(data[i : i + block]).hexdigest() for i in range(0, max(1, len(data)), block)]
    for _ in range(levels):
        level = [hashlib.sha256("".join(level[i : i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
    return hashlib.sha256("".join(level).encode()).hexdigest()


def test_tree_hashes_whatever_the_split(spark, tmp_path):
    root, rng = tmp_path / "in", random.Random(3)
    (root / "deep").mkdir(parents=True)
    contents = {"one": rng.randbytes(10_000), "deep/two": rng.randbytes(4096), "empty": b"", "deep/same": None, "three": rng.randbytes(1)}
    contents["deep/same"] = contents["one"]
    for name, data in contents.items():
        (root / name).write_bytes(data)
    (root / "_SUCCESS").write_bytes(b"x")
    (root / ".one.crc").write_bytes(b"x")
    want = {name: (len(d), max(1, -(-len(d) // 256)), plain_tree(d, 256, 4, 2)) for name, d in contents.items()}
    for split in (256, 1024, 1 << 20):
        got = blocks.tree_hashes(spark, str(root), block=256, fanout=4, levels=2, split=split)
        assert {os.path.relpath(r.path, root): (r.n_bytes, r.n_blocks, r.root) for r in got.collect()} == want
    assert want["one"] == want["deep/same"]
    alone = blocks.tree_hashes(spark, str(root / "one"), block=256, fanout=4, levels=2).collect()
    assert [r.root for r in alone] == [want["one"][2]]


def test_tree_fingerprints_find_changed_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_bytes(name.encode() * 5000)
    keys = lambda **p: spark.createDataFrame(blocks.tree_fingerprints(spark, str(tmp_path), "https://x", "csv", p, block=512, fanout=4, levels=1).collect(), "path string, key string")
    last = keys(a="1")
    assert files.changed_files(keys(a="1"), last).count() == 0
    assert files.changed_files(keys(a="2"), last).count() == 2
    data = bytearray((tmp_path / "b").read_bytes())
    data[4321] ^= 1
    (tmp_path / "b").write_bytes(bytes(data))
    assert [os.path.basename(r.path) for r in files.changed_files(keys(a="1"), last).collect()] == ["b"]


def test_tree_hashes_of_nothing(spark, tmp_path):
    assert blocks.tree_hashes(spark, str(tmp_path)).count() == 0
