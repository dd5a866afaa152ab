"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (an item of fewer words is one window). A document holds a
window when it holds all its shingles in place, so a window's necessary prefix is one shingle: its rarest, by how often
the whole corpus has it. Documents' shingles are looked up in a bitmap of bounded size that holds the prefix shingles;
survivors join the windows on the shingle, have to leave room for the window within the document (positional and length
bounds), and are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import written
from quire.llm.textkit import ALPHANUMERIC, Words, chain, tidy, words

SHINGLE = 5
#: Log of the bits of the bitmap, which follow the benchmark's size: 1 to 64 MB. A fuller one lets more through to the join.
BITMAP_BITS = (23, 29)
#: Windows that may be broadcast (some 300 bytes each); beyond it the join is shuffled.
BROADCAST_WINDOWS = 100_000


def window_table(items: DataFrame, window: int) -> DataFrame:
    """``item, length, window, off, shingle``: every window's words, and each shingle with its place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for w in words(batch.column(1), ALPHANUMERIC):
                each = w.hashes()
                for row, (b, e) in enumerate(zip(w.begins.tolist(), w.ends.tolist(), strict=True), w.first):
                    length = min(window, e - b)
                    size = min(SHINGLE, length)
                    item = batch.column(0)[row].as_py()
                    for at in range(b, e - length + 1) if length else ():
                        h = chain(each[at : at + length], size).view(np.int64).tolist()
                        out += [(item, length, w.text(at, at + length), off, x) for off, x in enumerate(h)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["item", "length", "window", "off", "shingle"])

    return items.mapInArrow(tidy(run), "item long, length int, window string, off int, shingle long")


def bitmap(shingles: DataFrame) -> np.ndarray:
    """The lowest bits of all shingles as a bitmap of some eight bits for each, within ``BITMAP_BITS``; it reaches the driver."""
    least, most = BITMAP_BITS
    size = min(most, max(least, (8 * shingles.count()).bit_length()))
    low = F.col("shingle").bitwiseAND((1 << size) - 1)
    parts = shingles.select(low.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << (size - 3), dtype=np.uint8)
    for k, bits in parts.toLocalIterator():
        # Buckets are numbered from 1; the first holds values 1..32768, and value 0 is in bucket 0's last place.
        at = (k - 1) * 4096
        if 0 <= at < len(out):
            out[at : at + 4096] |= np.frombuffer(bytes(bits), dtype=np.uint8)
    return out


def members(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the bitmap may hold. Bit v-1 stands for value v, and value 0 always passes."""
    low = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64) - 1
    return np.flatnonzero((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 | (low < 0))


def _hits(w: Words, sizes: list[int], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shingle size: first words and hashes of the shingles in the bitmap that lie within a row."""
    each = w.hashes()
    for size in sizes:
        h = chain(each, size)
        at = members(h, bits)
        row = np.searchsorted(w.ends, at, side="right")
        at = at[at + size <= w.ends[np.minimum(row, len(w.ends) - 1)]] if len(at) else at
        yield size, at, h[at]


def frequencies(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """``shingle, df``: how often the whole corpus holds each shingle that the bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for w in words(batch.column(1), ALPHANUMERIC) for _, _, h in _hits(w, sizes, bits)]
            h, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    return docs.mapInArrow(tidy(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("df"))


def candidates(docs: DataFrame, sizes: list[int], window: int, bits: np.ndarray) -> DataFrame:
    """A row ``id, key, n_words`` for each document, and one with ``at, shingle, size, lead, context`` for each shingle in the
    bitmap: ``context`` holds the words that a window with this shingle can reach, ``lead`` of them before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), ALPHANUMERIC):
                rows = len(w.begins)
                row, at, shingle, size, lead, context = list(range(rows)), [None] * rows, [None] * rows, [None] * rows, [None] * rows, [None] * rows
                for n, places, hashes in _hits(w, sizes, bits):
                    of = np.searchsorted(w.ends, places, side="right")
                    for r, p, h in zip(of.tolist(), places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        b, e = int(w.begins[r]), int(w.ends[r])
                        # A window of n words is this shingle alone, unless the shingle has the full size.
                        reach = window if n == SHINGLE else n
                        a, z = max(b, p + n - reach), min(e, p + reach)
                        row.append(r), at.append(p - b), shingle.append(h), size.append(n), lead.append(p - a), context.append(w.text(a, z))
                n_words = (w.ends - w.begins)[row]
                took = pa.array(np.array(row, dtype=np.int64) + w.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(took), batch.column(2).take(took), pa.array(n_words.astype(np.int64)), pa.array(at, pa.int32()), pa.array(shingle, pa.int64()), pa.array(size, pa.int32()), pa.array(lead, pa.int32()), pa.array(context, pa.string())],
                    ["id", "key", "n_words", "at", "shingle", "size", "lead", "context"],
                )

    return docs.mapInArrow(tidy(run), "id long, key long, n_words long, at int, shingle long, size int, lead int, context string")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, key_col: str | None = None) -> DataFrame:
    """Contamination of each document: ``<id>, n_words, n_hit, items, spans``.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters, in whole texts. ``items`` are the
    ids, in order, of the items of which a window occurs; ``spans`` the occurrences as ``start, stop`` word numbers,
    ``n_hit`` the words inside any of them. Null, empty and wordless texts have no words and no hits; such items have no
    windows. Without items no text has hits, and an empty table gives no rows. Items that share a window are all named. Repeated rows (same id, same text) give one row; rows that share an id but not the text stay apart, a null
    id is an id of its own. ``key_col`` names a further column with the ``xxhash64`` of the text, which tells such rows
    apart. Other columns, whatever their names, are not read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    table = written(window_table(items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")), window).distinct(), "windows")
    sizes = sorted(r[0] for r in table.select(F.least("length", F.lit(SHINGLE)).alias("s")).distinct().collect())
    df = frequencies(plain, sizes, bitmap(table.select("shingle")))
    ranked = table.join(df, "shingle", "left").groupBy("item", "length", "window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "shingle")).alias("r"))
    prefix = written(ranked.select("item", F.col("length").alias("len"), "window", F.col("r.off").alias("off"), F.col("r.shingle").alias("p_shingle")), "prefix")
    every = written(candidates(plain, sizes, window, bitmap(prefix.select(F.col("p_shingle").alias("shingle")))), "candidates")
    # Only candidates are joined; the rows of the documents themselves have no shingle to meet on.
    found, base = every.where("shingle is not null"), every.where("shingle is null").select("id", "key", "n_words")
    small = prefix.count() <= BROADCAST_WINDOWS
    start = F.col("at") - F.col("off")
    bounds = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("context", " "), F.col("lead") - F.col("off") + 1, F.col("len")), " ") == F.col("window")
    joined = found.join(F.broadcast(prefix) if small else prefix, (F.col("shingle") == F.col("p_shingle")) & (F.least("len", F.lit(SHINGLE)) == F.col("size")))
    fits = F.when((F.col("lead") >= F.col("off")) & bounds, same).otherwise(F.lit(False))
    hits = joined.where(fits).select("id", "key", "n_words", F.struct(start.alias("start"), (start + F.col("len")).alias("stop")).alias("span"), "item")
    rows = hits.unionByName(base, allowMissingColumns=True)
    per = rows.groupBy("id", "key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.stop - F.greatest(x.start, s.to))).alias("n"), F.greatest(s.to, x.stop).alias("to")))
    return per.select(F.col("id").alias(id_col), *([F.col("key").alias(key_col)] if key_col else []), "n_words", covered.n.cast("long").alias("n_hit"), "items", "spans")
