"""Conversation prefix tries: which conversations begin alike, and what shared prefixes save.

A conversation is a key: its turns' ids, fixed in width and big-endian, one after the other. Equal conversations are one key.
Sampled splitters deal sorted keys into ranges, and each task builds an adaptive radix tree over its range: inner nodes grow from
4 to 16, 48 and 256 branches, and bytes without a branch are compressed into one edge. Only depths that are whole turns emit
nodes of the result. Nodes on the paths to a range's first and last key may continue in its neighbours; these alone, two
paths for each range, are merged afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import written

#: Bytes of a turn's id: two 64-bit fingerprints of role and text.
WIDTH = 16
#: Keys of a range, about, and conversation ids that are joined to one text before ranges of them meet.
KEYS = 100_000
ENDS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of an adaptive radix tree: the bytes ``edge`` of its keys from its parent on, its branches by their first byte, and
    the number of the key that ends here, or -1. Up to 4 or 16 branches are sorted lists, up to 48 an index of places, beyond
    that a table of 256."""

    __slots__ = ("branches", "edge", "ends", "layout", "places")

    def __init__(self, edge: bytes, ends: int = -1) -> None:
        self.edge, self.ends, self.layout = edge, ends, 4
        self.places: bytearray = bytearray()
        self.branches: list = []

    def get(self, byte: int) -> Node | None:
        if self.layout == 256:
            return self.branches[byte]
        if self.layout == 48:
            at = self.places[byte]
            return self.branches[at - 1] if at else None
        at = self.places.find(byte)
        return self.branches[at] if at >= 0 else None

    def put(self, byte: int, child: Node) -> None:
        if self.layout < 48 and len(self.branches) == self.layout and self.places.find(byte) < 0:
            self._grow()
        elif self.layout == 48 and len(self.branches) == 48 and not self.places[byte]:
            self._grow()
        if self.layout == 256:
            self.branches[byte] = child
        elif self.layout == 48:
            if not self.places[byte]:
                self.branches.append(child)
                self.places[byte] = len(self.branches)
            else:
                self.branches[self.places[byte] - 1] = child
        elif (at := self.places.find(byte)) >= 0:
            self.branches[at] = child
        else:
            at = sum(b < byte for b in self.places)
            self.places.insert(at, byte)
            self.branches.insert(at, child)

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for i, b in enumerate(self.places):
                index[b] = i + 1
            self.places, self.layout = index, 48
        else:
            table: list = [None] * 256
            for b, at in enumerate(self.places):
                if at:
                    table[b] = self.branches[at - 1]
            self.branches, self.places, self.layout = table, bytearray(), 256

    def children(self) -> list[Node]:
        """In the order of their bytes."""
        if self.layout == 256:
            return [c for c in self.branches if c is not None]
        if self.layout == 48:
            return [self.branches[at - 1] for at in self.places if at]
        return self.branches


def shared_bytes(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax())


def insert(root: Node, key: bytes, number: int) -> None:
    node, at = root, 0
    while at < len(key):
        child = node.get(key[at])
        if child is None:
            node.put(key[at], Node(key[at:], number))
            return
        same = shared_bytes(child.edge, key[at : at + len(child.edge)])
        if same < len(child.edge):
            middle = Node(child.edge[:same])
            child.edge = child.edge[same:]
            middle.put(child.edge[0], child)
            node.put(key[at], middle)
            child = middle
        node, at = child, at + same
    node.ends = number


def _prefixes(key: bytes) -> list[bytes]:
    """Fingerprints of a key's prefixes of 0, 1, 2 ... turns."""
    state = hashlib.blake2b(digest_size=16)
    out = [state.digest()]
    for at in range(0, len(key), WIDTH):
        state.update(key[at : at + WIDTH])
        out.append(state.digest())
    return out


def turn_nodes(keys: list[bytes], n: list[int], least: list[int], words: list[np.ndarray], ends: list[str]) -> Iterator[tuple]:
    """Nodes at whole turns of the trie of sorted distinct ``keys`` (which stand for ``n`` conversations each, the smallest with the
    id ``least``): ``open, fp, parent_fp, depth, conv_id, parent, n_convs, n_children, n_leaves, saved, words, ends``.

    ``open`` nodes lie on the paths to the first or last key, and have fingerprints; their sums are without open nodes. Of the
    others, those with an open parent have its fingerprint.
    """
    root = Node(b"")
    for i, key in enumerate(keys):
        insert(root, key, i)
    # The paths to the first and the last key, and fingerprints of their prefixes.
    edges = [(e, _prefixes(e)) for e in {keys[0], keys[-1]}]
    total = np.concatenate(([0], np.cumsum(n)))
    order, todo = [], [(root, 0)]
    while todo:
        node, above = todo.pop()
        order.append((node, above))
        todo += [(c, above + len(node.edge)) for c in node.children()]
    # For each node, children first: its first key, past its last, smallest id, and sums and tops of the closed nodes below.
    state: dict[int, tuple] = {}
    for node, above in reversed(order):
        below = [state.pop(id(c)) for c in node.children()]
        lo = node.ends if node.ends >= 0 else below[0][0]
        hi = below[-1][1] if below else lo + 1
        n_convs, key, bottom = int(total[hi] - total[lo]), keys[lo], above + len(node.edge)
        smallest = min([x[2] for x in below] + ([least[node.ends]] if node.ends >= 0 else []))
        kids, leaves, saved = (sum(x[i] for x in below) for i in (3, 4, 5))
        tops = [row for x in below for row in x[6]]
        shared = [(shared_bytes(e, key[:bottom]) // WIDTH, fp) for e, fp in edges]
        deepest, prints = max(shared, key=lambda x: x[0])
        for d in range(bottom // WIDTH, above // WIDTH if node is not root else -1, -1):
            words_here = int(words[lo][d - 1]) if d else 0
            mine = ends[node.ends] if d * WIDTH == bottom and node.ends >= 0 else NO_ENDS
            if d <= deepest:
                for row in tops:
                    yield (False, None, prints[d], row[0], row[1], None, *row[2:])
                yield (True, prints[d], prints[d - 1] if d else None, d, smallest, None, n_convs, kids, leaves, saved, words_here, mine)
                kids, leaves, saved, tops = 0, 0, 0, []
            else:
                for row in tops:
                    yield (False, None, None, row[0], row[1], smallest, *row[2:])
                leaves, saved = leaves if kids else 1, saved + (n_convs - 1) * words_here
                tops = [(d, smallest, n_convs, kids, leaves, saved, words_here, mine)]
                kids = 1
        state[id(node)] = (lo, hi, smallest, kids, leaves, saved, tops)


_NODE = "open boolean, fp binary, parent_fp binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def range_nodes(keys: DataFrame, parts: int) -> DataFrame:
    """:func:`turn_nodes` of each range of ``key, n, least, words, ends``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        key = t["key"].to_pylist()
        order = sorted(range(len(key)), key=key.__getitem__)
        words = t["words"].combine_chunks()
        rows: list[tuple] = []
        took = [t[c].to_pylist() for c in ("n", "least", "ends")]
        for row in turn_nodes([key[i] for i in order], *([x[i] for i in order] for x in took[:2]), [np.asarray(words[i].values) for i in order], [took[2][i] for i in order]):
            rows.append(row)
            if len(rows) >= 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return keys.repartitionByRange(parts, "key").mapInArrow(run, _NODE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def merged_paths(open_nodes: DataFrame) -> DataFrame:
    """Open nodes of all ranges, merged by fingerprint, with the sums of their whole subtrees. Two paths for each range of keys
    meet in one task, deepest first; it holds sums of nodes whose parent is still to come."""
    once = open_nodes.groupBy("fp", "depth").agg(F.first("parent_fp").alias("parent_fp"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.first("words").alias("words"), F.min(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kids, leaves, saved = below.pop(r["fp"], (0, 0, 0))
                kids, saved = kids + r["n_children"], saved + r["saved_tokens"] + (r["n_convs"] - 1) * r["words"]
                leaves = leaves + r["n_leaves"] if kids else 1
                if r["parent_fp"] is not None:
                    up = below.setdefault(r["parent_fp"], [0, 0, 0])
                    up[0], up[1], up[2] = up[0] + 1, up[1] + leaves, up[2] + saved
                out.append((r["fp"], r["parent_fp"], r["depth"], r["conv_id"], r["n_convs"], kids, leaves, saved, r["ends_sha256"] or NO_ENDS))
            kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 9, kinds, strict=True)], ["fp", "parent_fp", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])

    return once.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(run, "fp binary, parent_fp binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def ends_digests(members: DataFrame) -> DataFrame:
    """``c1, c2, ends``: SHA-256 of each class's ids, in order, joined by commas. Ids combine in blocks; a class's blocks stream
    through one task in order, of which it holds one."""
    block = F.floor(F.col("conv_id") / ENDS)
    blocks = members.groupBy("c1", "c2", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, str]] = []
        now, state = None, hashlib.sha256()
        for batch in batches:
            for c1, c2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (c1, c2) == now:
                    state.update(b"," + ids.encode())
                    continue
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (c1, c2), hashlib.sha256(ids.encode())
            if len(done) > 10_000:
                yield made(done)
                done = []
        if now:
            done.append((*now, state.hexdigest()))
        yield made(done)

    def made(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["c1", "c2", "ends"])

    return blocks.repartition("c1", "c2").sortWithinPartitions("c1", "c2", "block").select("c1", "c2", "ids").mapInArrow(run, "c1 long, c2 long, ends string")


def rebuilt(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, head: int, group: int) -> DataFrame:
    """``conv_id, turns`` (``h1, h2, words`` in order): each conversation with the first turns of its group's first one."""
    t = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("conv_id is not null")
    hashes = [F.xxhash64(F.lit(i), F.octet_length("role"), "role", "text").alias(f"h{i}") for i in (1, 2)]
    n_words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long").alias("words")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    numbered = t.select("conv_id", "turn", "role", "text", *hashes, n_words).withColumn("at", at)
    own = written(numbered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "h1", "h2", "words"))).alias("turns")), "conversations")
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, head - 1).alias("first")).where(F.col("base") % group == 0)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(head)).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left").withColumn("h", h)
    every = F.concat(F.slice(F.coalesce("first", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return both.select("conv_id", F.transform(every, lambda x: F.struct(x.h1, x.h2, x.words)).alias("turns"))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", head: int = 4, group: int = 20) -> DataFrame:
    """A row for each distinct prefix of whole turns: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    Conversations are ordered by turn, null first, then role and text; null roles and texts are empty. Each is rebuilt: the first
    crc32(id) % ``head`` turns of the first conversation of its group of ``group`` ids, then its own after as many. A node's members are
    the conversations that begin with it; ``conv_id`` is the smallest, ``parent_conv_id`` the parent's (null at the root),
    ``n_leaves`` and ``saved_tokens`` are sums over its subtree, itself included, and ``ends_sha256`` is the hash of the ids that
    end at it. Repeated rows are turns each; conversations without turns are members of the root; rows without a conversation id are no
    conversation. Turns are equal when 128 bits of fingerprints are. An empty table gives no rows. Other columns are not
    read. A task holds a conversation's fingerprints, never its texts.
    """
    convs = written(rebuilt(turns, conv_col, turn_col, role_col, text_col, head, group), "rebuilt")
    classes = [F.xxhash64(F.lit(i), F.transform("turns", lambda x: F.struct(x.h1, x.h2))).alias(f"c{i}") for i in (1, 2)]
    members = convs.select("conv_id", *classes)
    counts = members.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    paths = counts.join(convs.select(F.col("conv_id").alias("least"), "turns"), "least").join(ends_digests(members), ["c1", "c2"])
    key = F.unhex(F.array_join(F.transform("turns", lambda x: F.concat(F.lpad(F.hex(x.h1), 16, "0"), F.lpad(F.hex(x.h2), 16, "0"))), ""))
    keys = written(paths.select(key.alias("key"), "n", "least", F.transform("turns", lambda x: x.words).alias("words"), "ends"), "keys")
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys.count() // KEYS)
    nodes = written(range_nodes(keys, parts), "nodes")
    top = written(merged_paths(nodes.where("open")), "paths")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = top.select(F.col("fp").alias("parent_fp"), F.col("conv_id").alias("__parent"))
    tops = top.join(above, "parent_fp", "left").withColumn("parent_conv_id", F.col("__parent"))
    closed = nodes.where("not open")
    inner = closed.where("parent_fp is null")
    outer = closed.where("parent_fp is not null").drop("parent_conv_id").join(above, "parent_fp").withColumn("parent_conv_id", F.col("__parent"))
    return inner.select(*out).unionByName(outer.select(*out)).unionByName(tops.select(*out))
