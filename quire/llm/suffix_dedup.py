"""Repeated substrings by a sparse suffix array.

Suffixes that begin at anchors are sorted: every string of ``length`` bytes has one anchor, the least 8-byte gram (by hash)
of those that begin within its first ``SPAN`` bytes, so that equal strings have theirs at the same place, and an anchor is
that of a run of neighbouring strings. The tokens of a suffix are fingerprints of growing reach: of the bytes that all strings
of its run share (``c``), and of all bytes of its run (``f``).

Sampled splitters deal suffixes into ranges by leading tokens; each range is sorted on its own by multikey quicksort, and its
ends are compared with those of other ranges. Suffixes without an equal first token hold no repeated string; where both
tokens are equal, all strings of the run are repeated; the others are cut into shorter runs and sorted again, down to single
strings. Ranges follow the whole key, place included, so an equal key of any number of rows fills as many ranges as it needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import discard, written
from quire.llm.textkit import chunks, mix, string_bytes

#: First bytes of a string among which its anchor is; the least length of strings is more by a gram and some bytes.
SPAN = 128
#: Strings of a run at the second level.
BLOCK = 8
#: Bytes of texts, and runs with bytes, that are handled at a time.
CHUNK = 1 << 18
RUNS = 2000
#: Suffixes of a range, about.
RANGE = 500_000
_SEEDS = np.random.default_rng(77).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KEY = ["id", "key"]
SUFFIX = "c long, f long, id long, key long, at int, lo int, hi int, open boolean"


class Fingerprints:
    """Two independent 64-bit fingerprints of any slices of ``data``."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        for which, base in enumerate(_BASES):
            if len(_powers.get(which, ((),))[0]) < n:
                up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
                up[0] = down[0] = 1
                _powers[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(_SEEDS[i][data] * _powers[i][0][: n - 1]))) for i in (0, 1)]

    def of(self, which: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return mix((s[b] - s[a]) * _powers[which][1][a] + (b - a).astype(np.uint64)).view(np.int64)


def anchors(at: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows ``data[at[i]:at[i+1]]``: row, anchor, and the first and last string begin of each run of strings that share an anchor."""
    n, empty = len(data), np.empty(0, np.int64)
    rows = np.flatnonzero(np.diff(at) >= length)
    if not len(rows):
        return empty, empty, empty, empty
    padded = np.concatenate((data, np.zeros(16, np.uint8))).tobytes()
    h = np.empty(n + 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded, "<u8", offset=k, count=(n + 8 - k + 7) // 8)
        h[k::8] = part[: len(h[k::8])]
    h = h[:n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h = ((h ^ (h >> np.uint64(28))) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width < SPAN:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    best = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.ones(len(best) + 1, dtype=bool)
    change[1:-1] = best[1:] != best[:-1]
    change[at[rows]] = True
    first = np.flatnonzero(change[:-1])
    row = np.searchsorted(at, first, side="right") - 1
    last = np.concatenate((first[1:], [len(best)])) - 1
    last = np.minimum(last, at[row + 1] - length)  # strings end within their row
    good = first <= last
    return row[good], best[first[good]], first[good], last[good]


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their tokens: each token sorts only runs that are equal in all tokens before it."""
    order = np.argsort(tokens[0], kind="stable")
    run = np.concatenate(([True], tokens[0][order][1:] != tokens[0][order][:-1])) if len(order) else np.empty(0, bool)
    for token in tokens[1:]:
        ties = np.flatnonzero(~run | np.concatenate((~run[1:], [False])))
        if not len(ties):
            break
        group, value = np.cumsum(run)[ties], token[order[ties]]
        inner = np.lexsort((value, group))
        order[ties] = order[ties[inner]]
        group, value = group[inner], value[inner]
        run[ties] |= np.concatenate(([True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])))
    return order


def ranged(suffixes: DataFrame, parts: int) -> DataFrame:
    """Suffixes that are not alone with their first token, with ``covered`` (an equal key elsewhere) and ``stand`` (one of each
    key stands for it where keys with its first token differ)."""

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        c, f = table["c"].to_numpy(), table["f"].to_numpy()
        order = multikey_order([c, f])
        c, f = c[order], f[order]
        new_c = np.concatenate(([True], c[1:] != c[:-1]))
        new_f = new_c | np.concatenate(([True], f[1:] != f[:-1]))
        size = lambda new: np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1]
        n_c, n_f = size(new_c), size(new_f)
        end = (c == c[0]) | (c == c[-1])  # other ranges may hold rows like these
        edge = np.zeros(len(c), dtype=bool)
        edge[[0, -1]] = True
        stay = (n_c > 1) | end
        out = table.take(pa.array(order[stay]))
        out = out.append_column("__n_c", pa.array(n_c[stay])).append_column("__n_f", pa.array(n_f[stay])).append_column("__first", pa.array(new_f[stay])).append_column("__edge", pa.array(edge[stay]))
        out = out.append_column("__part", pa.array(np.full(out.num_rows, TaskContext.get().partitionId(), np.int64)))
        del held, table
        yield from out.to_batches()
        pa.default_memory_pool().release_unused()

    dealt = suffixes.repartitionByRange(parts, "c", "f", "id", "key", "at", "lo")
    found = written(dealt.mapInArrow(bucket, SUFFIX + ", __n_c long, __n_f long, __first boolean, __edge boolean, __part long"), "ranges")
    # Keys at the ends of ranges, two for each: those of more than one range are equal across a boundary.
    ends = found.where("__edge").select("c", "f", "__part").distinct()
    c2 = ends.groupBy("c").agg((F.countDistinct("__part") > 1).alias("__c2")).where("__c2")
    f2 = ends.groupBy("c", "f").agg((F.countDistinct("__part") > 1).alias("__f2")).where("__f2")
    # At most two keys for each range, and only those that go on in another: few, whatever the rows.
    every = found.join(F.broadcast(c2), "c", "left").join(F.broadcast(f2), ["c", "f"], "left")
    covered = (F.col("__n_f") > 1) | F.coalesce("__f2", F.lit(False))
    shared = (F.col("__n_c") > 1) | F.coalesce("__c2", F.lit(False))
    mixed = (F.col("__n_c") > F.col("__n_f")) | F.coalesce("__c2", F.lit(False))
    names = [c.split()[0] for c in SUFFIX.split(", ")]
    out = written(every.where(shared).select(*names, covered.alias("covered"), (covered & mixed & F.col("__first")).alias("stand")), "level")
    discard(found)
    return out


def first_level(docs: DataFrame, length: int) -> DataFrame:
    """The anchors of all texts as suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, at, data in chunks(batch.column(2), CHUNK):
                r, p, lo, hi = anchors(at, data, length)
                if len(r):
                    prints, base, took = Fingerprints(data), at[r], pa.array(r + row)
                    ints = [pa.array((x - base).astype(np.int32)) for x in (p, lo, hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(prints.of(0, p, p + length - SPAN + 1)), pa.array(prints.of(1, lo, hi + length)), batch.column(0).take(took), batch.column(1).take(took), *ints, pa.array(np.ones(len(r), bool))], [c.split()[0] for c in SUFFIX.split(", ")])

    return docs.mapInArrow(run, SUFFIX)


def with_bytes(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """``rows`` with the bytes of their runs."""
    wanted = rows.groupBy(*_KEY).agg(F.collect_set(F.struct("at", "lo", "hi", "open")).alias("runs"))
    both = docs.join(wanted, docs.id.eqNullSafe(wanted.id) & (docs.key == wanted.key)).select(docs.id, docs.key, "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, runs = batch.column(2).cast(pa.binary()), batch.column(3)
            raw: list[bytes] = []
            since = 0
            for i in range(batch.num_rows):
                whole, flat = text[i].as_py(), runs[i].values
                raw += [whole[a : b + length] for a, b in zip(flat.field("lo").to_pylist(), flat.field("hi").to_pylist(), strict=True)]
                if len(raw) >= RUNS or i == batch.num_rows - 1:
                    part = batch.slice(since, i + 1 - since)
                    flat, of = part.column(3).flatten(), pa.array(np.repeat(np.arange(part.num_rows), part.column(3).value_lengths().to_numpy()))
                    yield pa.RecordBatch.from_arrays([part.column(j).take(of) for j in (0, 1)] + [flat.field(x) for x in ("at", "lo", "hi", "open")] + [pa.array(raw, pa.binary())], ["id", "key", "at", "lo", "hi", "open", "raw"])
                    raw, since = [], i + 1

    return both.mapInArrow(run, "id long, key long, at int, lo int, hi int, open boolean, raw binary")


def shorter(rows: DataFrame, length: int, block: int) -> DataFrame:
    """Runs of ``rows`` (with bytes) cut where the distance to the anchor is a multiple of ``block``, as suffixes of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, RUNS) for b in batches for i in range(0, b.num_rows, RUNS)):
            at, lo, hi = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
            start, data = string_bytes(batch.column(6))
            data, start = data[start[0] : start[-1]], start - start[0]
            low, high = (at - hi) // block, (at - lo) // block
            n = high - low + 1
            of = np.repeat(np.arange(len(n)), n)
            j = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            # All strings of a block, those beyond the run too, share the bytes from its last begin on.
            inner = at[of] - j * block
            b, e = np.maximum(lo[of], inner - block + 1), np.minimum(hi[of], inner)
            prints, shift = Fingerprints(data), start[:-1][of] - lo[of]
            took = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(prints.of(0, inner + shift, inner - block + 1 + length + shift)), pa.array(prints.of(1, b + shift, e + length + shift)), batch.column(0).take(took), batch.column(1).take(took), *(pa.array(x.astype(np.int32)) for x in (at[of], b, e)), batch.column(5).take(took)], [c.split()[0] for c in SUFFIX.split(", ")])

    return rows.select("id", "key", "at", "lo", "hi", "open", "raw").mapInArrow(run, SUFFIX)


def cut(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of documents with repeated strings at ``runs`` (``lo, hi``)."""
    per = runs.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    both = docs.join(per.withColumnsRenamed({"id": "__id", "key": "__key"}), docs.id.eqNullSafe(F.col("__id")) & (docs.key == F.col("__key")), "left").select("id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, out = batch.column(1).cast(pa.binary()), []
            for i in range(batch.num_rows):
                raw, flat = text[i].as_buffer(), batch.column(2)[i].values
                depth = np.zeros(len(raw) + 1, np.int32)
                np.add.at(depth, flat.field("lo").to_numpy(), 1)
                np.add.at(depth, flat.field("hi").to_numpy() + length, -1)
                gone = np.cumsum(depth[:-1]) > 0
                ends = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), len(ends) // 2, hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in zip(ends[::2], ends[1::2], strict=True)]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    spans = "array<struct<start:bigint,stop:bigint>>"
    touched = both.where("runs is not null").mapInArrow(run, f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {spans}")
    zero = F.lit(0).cast("long")
    whole = both.where("runs is null").select("id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.array().cast(spans).alias("spans"))
    return touched.unionByName(whole)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``<id>, n_bytes, n_removed, n_spans, kept_sha256, spans``, one row per row of ``docs``.

    Texts are their UTF-8 bytes. Every byte that a string of ``length`` bytes covers which also begins anywhere else, in the same
    text too, is removed; overlaps count, and all is judged on the input. ``spans`` are the maximal removed runs,
    ``kept_sha256`` is the hash of what is left. Null texts are empty; texts shorter than ``length`` stay whole; repeated rows and copies
    go whole, since each is elsewhere too; null ids are ids. Strings are equal when 128 bits of fingerprints are. Texts of
    one repeated byte have as many anchors as bytes; they cost more, with the same results. An empty table gives no rows.
    Other columns are not read. ``length`` has to be over ``SPAN`` by 16 or more.
    """
    if length < SPAN + 16:
        raise ValueError(f"length is {SPAN + 16} at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    size = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parts(n: int) -> int:
        return max(least, n // RANGE)

    runs, levels = [], [level := ranged(first_level(plain, length), parts(2 * size // SPAN))]
    raw = None
    for block in (BLOCK, 1, None):
        runs.append(level.where("covered and open").select(*_KEY, "lo", "hi"))
        # What has no equal key yet, and one of each key that it may be like.
        rest = level.where("not covered or stand").withColumn("open", F.col("open") & ~F.col("covered"))
        if block is None or (n := rest.count()) == 0:
            break
        if raw is None:
            raw = written(with_bytes(plain, rest, length), "bytes")
            level = shorter(raw, length, block)
        else:
            mine = rest.select("id", "key", "at", F.col("lo").alias("b"), F.col("hi").alias("e"), F.col("open").alias("o"))
            again = raw.drop("open").join(mine.withColumnRenamed("id", "__id"), raw.id.eqNullSafe(F.col("__id")) & (raw.key == mine.key) & (raw["at"] == mine["at"]) & (F.col("lo") <= F.col("b")) & (F.col("e") <= F.col("hi")))
            piece = F.expr(f"substring(raw, b - lo + 1, e - b + {length})")
            level = shorter(again.select(raw.id, raw.key, raw["at"], F.col("b").alias("lo"), F.col("e").alias("hi"), F.col("o").alias("open"), piece.alias("raw")), length, block)
        levels.append(level := ranged(level, parts(n * (SPAN // 2 // BLOCK if block > 1 else BLOCK))))
    found = runs[0]
    for r in runs[1:]:
        found = found.unionByName(r)
    found = written(found.distinct(), "runs")
    for done in (*levels, *([raw] if raw is not None else [])):
        discard(done)
    return cut(plain, found, length).withColumnRenamed("id", id_col)
