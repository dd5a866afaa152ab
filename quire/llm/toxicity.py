"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts and unlabelled texts, never confirmed clean ones. With class prior p, positive risk
R+ and unlabelled risk Ru-, the risk of a classifier is p*R+(+1) + max(0, Ru-(-1) - p*R+(-1)): the second term is what the
unlabelled texts that are in truth clean would cost, and it must not fall below zero, or the learner would fit single texts.

A text is the set of its words and of their beginnings (3 to 7 bytes), hashed into buckets. Executors count the buckets
over the training rows; those that stand out enter a logistic model that numpy fits on the driver, from a bounded sample:
at most about ``positives`` toxic and ``unlabelled`` unlabelled texts, as rows of ``features`` bits. Scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import fresh, written
from quire.llm.textkit import _TABLE, ALPHANUMERIC, Words, mix, powers, tidy, words

BUCKET_BITS = 20
PREFIXES = (3, 4, 5, 6, 7)


def held_out(id_col: str | Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 4, is 2. Null ids are not held out."""
    text = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % 4 == 2, F.lit(False))


def buckets(w: Words) -> Iterator[np.ndarray]:
    """Bucket numbers of every word, then of every word's beginning of each length (-1 where the word is no longer)."""
    up, down = powers(len(w.data) + 1)
    sums = np.zeros(len(w.data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[w.data] * up[:-1], out=sums[1:])
    first, shift, length = sums[w.start], down[w.start], w.end - w.start
    for size in (0, *PREFIXES):
        stop = w.end if size == 0 else np.minimum(w.start + size, w.end)
        x = (mix((sums[stop] - first) * shift + np.uint64(size)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        if size:
            x[length <= size] = -1
        yield x


def present(w: Words, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs; features are bucket numbers, or ``table[bucket]`` where that is not negative."""
    at, features = [], []
    for x in buckets(w):
        if table is not None:
            x = table[x]  # the last entry, for -1, is -1 too
        on = np.flatnonzero(x >= 0)
        at.append(on), features.append(x[on])
    row = np.searchsorted(w.ends, np.concatenate(at), side="right")
    pair = np.unique((row << BUCKET_BITS) + np.concatenate(features))
    return pair >> BUCKET_BITS, pair & ((1 << BUCKET_BITS) - 1)


@dataclass
class Model:
    """Weights of the chosen buckets; ``table`` maps a bucket to its feature number or to -1."""

    table: np.ndarray
    weights: np.ndarray
    bias: float


def blank_table() -> np.ndarray:
    return np.full((1 << BUCKET_BITS) + 1, -1, dtype=np.int64)


def bucket_counts(texts: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """``bucket, n``: in how many of the texts each bucket occurs; with a table, only the buckets it knows, by its numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for w in words(batch.column(0), ALPHANUMERIC):
                counts += np.bincount(present(w, table)[1], minlength=1 << BUCKET_BITS)
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(counts[on])], ["bucket", "n"])

    return texts.select("text").mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with sigmoid loss, over feature rows of positive and unlabelled texts.
    Where the clean part of the risk is below zero, the step goes against it, as the method asks."""
    p, u = p.astype(np.float32), u.astype(np.float32)
    theta, m, v = (np.zeros(p.shape[1] + 1, dtype=np.float32) for _ in range(3))
    theta[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ theta[:-1] + theta[-1], -30, 30))) for x in (p, u))
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        clean = su.mean() - prior * sp.mean()
        weight_p, weight_u = (-2 * prior * dp, du) if clean >= 0 else (prior * dp, -du)
        grad = np.append(p.T @ weight_p + u.T @ weight_u, weight_p.sum() + weight_u.sum())
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1].astype(np.float64), float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = 6000, unlabelled: int = 14000, features: int = 1024) -> Model:
    """Fit on rows that are not held out. ``labels`` rows with ``label_col`` 1 are the confirmed ones; an id with several
    labels counts as toxic if one says so. The class prior is the share of toxic labels. Without toxic labels, or without
    unlabelled texts, every text scores 0."""
    seen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    seen = seen.groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    n_labels, n_toxic = seen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    blank = Model(blank_table(), np.zeros(1), -np.inf)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & ~held_out("id"))
    n_docs = plain.count()
    if not n_toxic or not n_docs:
        return blank
    prior = min(max(n_toxic / n_labels, 1e-4), 0.9)
    draw = F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(1_000_000)) / 1e6
    chosen = seen.where("toxic = 1").select(F.col("l_id").alias("id")).where(draw < positives / n_toxic)
    # The unlabelled texts are drawn from all rows, so that their share of toxic ones is the prior.
    # About ``positives`` ids at most, whatever the input's size: they are broadcast, and no text is shuffled.
    toxic_rows = written(plain.join(F.broadcast(chosen), "id", "left_semi").select("text"), "positive")
    other_rows = written(plain.where(draw < unlabelled / n_docs).select("text"), "unlabelled")
    n_p, n_u = toxic_rows.count(), other_rows.count()
    if not n_p or not n_u:
        return blank
    # Of the buckets that most toxic texts hold, those stand out that few of the unlabelled ones hold.
    common = bucket_counts(toxic_rows).where(F.col("n") > max(1, n_p // 400)).orderBy(F.desc("n"), "bucket").limit(16 * features).collect()
    table = blank_table()
    table[[r["bucket"] for r in common]] = np.arange(len(common))
    pos = np.array([r["n"] for r in common], dtype=float)
    unl = np.zeros(len(common))
    for r in bucket_counts(other_rows, table).collect():
        unl[r["bucket"]] = r["n"]
    share = (pos + unl) / (n_p + n_u)
    z = (pos / n_p - unl / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    best = [i for i in np.argsort(-z, kind="stable")[:features] if z[i] > 3]
    if not best:
        return blank
    table = blank_table()
    table[[common[i]["bucket"] for i in best]] = np.arange(len(best))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, len(best)), dtype=bool)
            for w in words(batch.column(0), ALPHANUMERIC):
                row, feature = present(w, table)
                x[row + w.first, feature] = True
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["bits"])

    def matrix(rows: DataFrame) -> np.ndarray:
        packed = b"".join(bytes(r[0]) for r in rows.mapInArrow(tidy(bits), "bits binary").collect())
        return np.unpackbits(np.frombuffer(packed, dtype=np.uint8).reshape(-1, -(-len(best) // 8)), axis=1)[:, : len(best)]

    return Model(table, *fit(matrix(toxic_rows), matrix(other_rows), prior))


def score(docs: DataFrame, model: Model, text_col: str, *keep: str, out: str = "score") -> DataFrame:
    """``keep`` columns and ``out``, the score, of every row, from the whole text alone; null and empty texts score as wordless."""
    table, weights, bias = model.table, model.weights, model.bias
    sent = [F.col(c) for c in keep] if text_col in keep else [*map(F.col, keep), F.col(text_col).alias(*fresh(docs, "text"))]
    at = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(at), ALPHANUMERIC):
                row, feature = present(w, table)
                z = np.full(len(w.begins), bias)
                z += np.bincount(row, weights=weights[feature], minlength=len(w.begins))
                s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                s[np.isneginf(z)] = 0.0
                rows = batch.slice(w.first, len(w.begins))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(s)], [*keep, out])

    schema = docs.select(*keep).schema.add(out, "double")
    return docs.select(*sent).mapInArrow(tidy(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **bounds: int) -> DataFrame:
    """``<id>, held_out, score, predicted`` for every row of ``docs``, repeated rows and null ids included.

    Null and empty texts score as wordless ones: by the class prior alone, low where toxic texts are rare. Texts of any length are
    read whole. Equal texts have equal scores; a score at the threshold is predicted 1. An empty table gives no rows, and
    without toxic labels all scores are 0. Other columns, whatever their names, are not read. ``bounds`` go to :func:`train`."""
    scored = score(docs, train(docs, labels, id_col, text_col, label_col, **bounds), text_col, id_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
