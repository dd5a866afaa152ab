"""Phrase collocations by SON partitioning.

Input partitions are dealt into shards. Each shard is mined completely at the proportionally lowered support
``ceil(support / shards)``: a phrase with ``support`` occurrences in all has that many in one shard at least. Within a shard
phrases grow from pairs to triples, and only of frequent parts. What is frequent in any shard is a candidate; candidates
are then counted in all texts, as tuples of words. A shard is a share of the corpus, mined by many tasks: tasks count the
phrases of their own texts and send sorted runs of hashes, which meet by hash range.

Words are known by 64-bit hashes that hold the language; the run ends with an error if two words share one. Hashes of
phrases only choose candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.decontaminate import bitmap, members
from quire.llm.shared import discard, written
from quire.llm.textkit import Words, byte_class, chain, mix, words

#: Pieces end at [.,;:!?\x0A-\x0D]; words of a piece are [^\x20\x09]+.
BREAKS = np.zeros(256, dtype=np.int32)
BREAKS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 1
INSIDE = byte_class(b" \t.,;:!?\x0a\x0b\x0c\x0d")
#: Entries that a task gathers before it sends them, and those of a hash range that meet in one task, about.
ENTRIES = 3_000_000
RANGE = 2_000_000


def _salts(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], dtype=np.uint64)


def _keys(w: Words, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words, with their row's language in them, and whether each word stands with the next in one piece."""
    row = np.repeat(np.arange(len(w.begins)), w.ends - w.begins)
    keys = mix(w.hashes() ^ salt[w.first + row])
    breaks = np.concatenate(([0], np.cumsum(BREAKS[w.data])))
    joined = (breaks[w.end[:-1]] == breaks[w.start[1:]]) & (row[1:] == row[:-1]) if len(row) else np.empty(0, dtype=bool)
    return keys, joined


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    salt = _salts(batch.column(0).to_pylist()) if batch.num_rows else np.empty(0, np.uint64)
    for w in words(batch.column(1), INSIDE):
        yield w, *_keys(w, salt)


def word_table(docs: DataFrame) -> DataFrame:
    """``lang, k, word, n`` of all words of ``lang, text``; ``k`` is the word's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> Iterator[pa.RecordBatch]:
            if held:
                yield from pa.concat_tables(held).group_by(["lang", "k", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "k", "word", "n"]).to_batches()

        for batch in batches:
            langs = batch.column(0)
            for w, keys, _ in _texts(batch):
                if not len(keys):
                    continue
                k, first, n = np.unique(keys, return_index=True, return_counts=True)
                # Every second value between the ends and starts of words is a word.
                cuts = np.stack([w.start, w.end], axis=1).ravel().astype(np.int32)
                spans = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(w.data)])
                row = w.first + np.searchsorted(w.ends, first, side="right")
                held.append(pa.table({"lang": langs.take(pa.array(row)), "k": pa.array(k.view(np.int64)), "word": spans.take(pa.array(2 * first)).cast(pa.string()), "n": pa.array(n.astype(np.int64))}))
                if sum(t.num_rows for t in held) > ENTRIES // 4:
                    yield from merged()
                    held.clear()
        yield from merged()

    found = docs.mapInArrow(run, "lang string, k long, word string, n long")
    return found.groupBy("lang", "k").agg(F.min("word").alias("word"), F.max("word").alias("__last"), F.sum("n").alias("n"))


def _pairs(keys: np.ndarray, joined: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all pairs of words that may be frequent."""
    may = np.zeros(len(keys), dtype=bool)
    may[members(keys, frequent)] = True
    at = np.flatnonzero(joined & may[:-1] & may[1:]) if len(keys) else np.empty(0, np.int64)
    return at, chain(keys, 2)[at] if len(at) else np.empty(0, np.uint64)


def _triples(keys: np.ndarray, at: np.ndarray, h: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """First words of all triples of which both pairs may be candidates."""
    may = np.zeros(len(keys) + 1, dtype=bool)
    may[at[members(h, pairs)]] = True
    return np.flatnonzero(may[:-1] & may[1:])


def mined(docs: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], shards: int, least: int, ranges: int) -> DataFrame:
    """Distinct hashes ``shingle`` that some shard holds ``least`` times; ``hashes`` gives those of a text's phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() % shards, [], 0

        def sent() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            cuts = np.searchsorted(h, np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64))
            parts = [(i, a, b) for i, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True)) if b > a]
            n = np.minimum(n, 1 << 31).astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([shard * ranges + i for i, _, _ in parts], pa.int64()), pa.array([h[a:b].tobytes() for _, a, b in parts], pa.binary()), pa.array([n[a:b].tobytes() for _, a, b in parts], pa.binary())], ["part", "h", "n"])

        for batch in batches:
            for _, keys, joined in _texts(batch):
                held.append(hashes(keys, joined))
                size += len(held[-1])
                if size > ENTRIES:
                    yield sent()
                    held.clear()
                    size = 0
        yield sent()

    def frequent(_: tuple, group: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group["h"]])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group["n"]])
        order = np.argsort(h)
        h, n = h[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return pa.table({"shingle": pa.array(h[first][np.add.reduceat(n, first) >= least].view(np.int64))})

    runs = docs.mapInArrow(run, "part long, h binary, n binary")
    return runs.groupBy("part").applyInArrow(frequent, "shingle long").distinct()


def counted(docs: DataFrame, frequent: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> DataFrame:
    """``k1, k2, k3, n``: occurrences in all texts of the phrases whose hashes the bitmaps hold, told apart by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def sent() -> pa.RecordBatch:
            h, *k = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            odd = np.flatnonzero(np.any([x != x[first][of] for x in k], axis=0))  # other words with the same hash
            n = n - np.bincount(of[odd], minlength=len(first))
            rows, n = np.concatenate([first, odd]), np.concatenate([n, np.ones(len(odd), dtype=n.dtype)])
            third = k[2][rows]
            columns = [pa.array(x[rows].view(np.int64)) for x in k[:2]] + [pa.array(third.view(np.int64), mask=k[3][rows]), pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "k3", "n"])

        for batch in batches:
            for _, keys, joined in _texts(batch):
                at, h = _pairs(keys, joined, frequent)
                three = _triples(keys, at, h, pairs)
                h3 = chain(keys, 3)[three] if len(three) else np.empty(0, np.uint64)
                hit, hit3 = members(h, pairs), members(h3, triples)
                for p, x, two in ((at[hit], h[hit], True), (three[hit3], h3[hit3], False)):
                    if len(p):
                        held.append((x, keys[p], keys[p + 1], np.zeros(len(p), np.uint64) if two else keys[p + 2], np.full(len(p), two)))
                if sum(len(x[0]) for x in held) > ENTRIES // 2:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    return docs.mapInArrow(run, "k1 long, k2 long, k3 long, n long").groupBy("k1", "k2", "k3").agg(F.sum("n").alias("a"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 10, inside: int = 50, top: int = 2000, shards: int = 4) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of two and three words.

    Texts are lower-cased (A-Z) and split into pieces and words; ``n`` counts the language's words, ``a`` the phrase's
    occurrences, overlaps included. Phrases with ``a`` of ``support`` or more are candidates. A cut gives ``l`` and ``r``, the
    occurrences of its sides, and floor(10**6 * a * a / (l * r)), exactly; the lowest cut counts, the first one of equals. Candidates
    inside a longer one with ``inside`` percent of their occurrences or more go. Ranks follow score, then ``a``, both
    descending, then the phrase by its UTF-8 bytes. Null languages are ``und``; null and empty texts have no words; repeated
    rows count each; texts may be of any length; an empty table gives no rows. Other columns are not read.
    """
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    table = written(word_table(plain), "words")
    if not table.where("word <> __last").isEmpty():
        raise ValueError("two words share a 64-bit hash")
    totals = written(table.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    n_words = totals.agg(F.sum("total")).first()[0] or 0
    often = written(table.where(F.col("n") >= support).select("lang", "k", "word", "n"), "often")
    frequent = bitmap(often.select(F.col("k").alias("shingle")))
    least, ranges = -(-support // shards), max(4, -(-n_words // (shards * RANGE)))
    two = written(mined(plain, lambda k, j: _pairs(k, j, frequent)[1], shards, least, ranges), "pairs")
    pairs = bitmap(two)

    def third(keys: np.ndarray, joined: np.ndarray) -> np.ndarray:
        at = _triples(keys, *_pairs(keys, joined, frequent), pairs)
        return chain(keys, 3)[at] if len(at) else np.empty(0, np.uint64)

    three = written(mined(plain, third, shards, least, ranges), "triples")
    found = written(counted(plain, frequent, pairs, bitmap(three)).where(F.col("a") >= support), "counted")
    for t in (two, three, table):
        discard(t)
    short, long = found.where("k3 is null").select("k1", "k2", "a"), found.where("k3 is not null")

    def word(i: int) -> DataFrame:
        return often.select(F.col("k").alias(f"k{i}"), F.col("word").alias(f"w{i}"), F.col("n").alias(f"n{i}"), *(["lang"] if i == 1 else []))

    def score(left: str, right: str) -> F.Column:
        return F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) div (CAST({left} AS DECIMAL(18,0)) * CAST({right} AS DECIMAL(18,0)))")

    front, back = short.select("k1", "k2", F.col("a").alias("f12")), short.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("a").alias("f23"))
    long = long.join(front, ["k1", "k2"]).join(back, ["k2", "k3"])
    longs = long.join(word(1), "k1").join(word(2), "k2").join(word(3), "k3").withColumns({"s1": score("n1", "f23"), "s2": score("f12", "n3")})
    one = F.col("s1") <= F.col("s2")
    longs = longs.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(one, F.col("n1")).otherwise(F.col("f12")).alias("l"), F.when(one, F.col("f23")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"))
    holders = long.select("k1", "k2", "a").union(long.select("k2", "k3", "a")).groupBy("k1", "k2").agg(F.max("a").alias("longer"))
    kept = short.join(holders, ["k1", "k2"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * inside, F.lit(True)))
    shorts = kept.join(word(1), "k1").join(word(2), "k2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), score("n1", "n2").alias("score"))
    # A limit for each language applies within tasks before rows of a language meet.
    ranked = longs.unionByName(shorts).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
