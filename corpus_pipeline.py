"""A training corpus from raw documents: five stages, each one of the operators in ``quire.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; its result is written as Parquet and
read again as the next one's documents. All but the last return the columns of ``docs``, extra ones included, whatever
their names. An empty table goes through as one. Null and empty texts pass every filter, and texts of any length are read
whole. ``doc_id`` identifies a document; rows without one are documents of their own. The stages bound the bytes of the session's
Arrow batches, unless it does so itself: a batch's memory then doesn't follow the length of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.decontaminate import decontaminate
from quire.llm.near_dedup import near_dedup
from quire.llm.pii import pseudonymise
from quire.llm.queries import DEMO_KEY
from quire.llm.shared import bounded_batches, fresh, table, written
from quire.llm.subwords import encode
from quire.llm.toxicity import score, train

TOXIC = 0.3
#: Units that a task of the last stage keeps: its workers share an executor with a heap that earlier stages have grown.
UNITS_KEPT = 100_000
#: Ids of near-duplicates that may be broadcast (some tens of bytes each), so that no text is shuffled; beyond it all are.
BROADCAST_IDS = 1_000_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned score calls toxic, a score at the threshold included, go. Equal texts go or stay together,
    null and empty ones stay where wordless texts score low, as they do by the class prior of the labels."""
    bounded_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    (out,) = fresh(docs, "toxicity")
    return score(docs, model, "text", *docs.columns, out=out).where(F.col(out) < TOXIC).drop(out)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Of rows that repeat an id and its text one
    stays; rows that share an id but not the text stay if one of them does. Null and empty texts are no group."""
    bounded_batches(spark)
    found = written(near_dedup(docs).where("doc_id is not null"), "components")
    known, repeated = fresh(docs, "known", "repeated")
    dropped = written(found.groupBy(F.col("doc_id").alias(known)).agg(F.max("kept").alias("kept")).where("not kept").select(known), "dropped")
    out = docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped, docs.doc_id == F.col(known), "left_anti")
    twice = written(found.groupBy(F.col("doc_id").alias(repeated)).agg(F.count("*").alias("n")).where("n > 1").select(repeated), "repeated")
    if twice.isEmpty():
        return out
    again = out.doc_id == F.col(repeated)
    return out.join(twice, again, "left_anti").unionByName(out.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; of rows that share an id, or have none, those whose text does. Null,
    empty and wordless texts stay, and all do without a benchmark."""
    bounded_batches(spark)
    known, key = fresh(docs, "known", "key")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), key_col=key).where("n_hit > 0")
    dropped = found.select(F.col("doc_id").alias(known), key)
    return docs.join(dropped, docs.doc_id.eqNullSafe(F.col(known)) & (F.xxhash64(docs.text) == F.col(key)), "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms, equal ones the same; ``n_chars`` follows the text. All rows stay,
    repeated ones too; a null text stays null."""
    bounded_batches(spark)
    (kinds,) = fresh(docs, "kinds")
    hidden = pseudonymise(docs, DEMO_KEY, kinds_col=kinds).drop(kinds)
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else hidden


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces, with sampled segmentations. All rows stay; null and empty texts have no pieces."""
    bounded_batches(spark)
    return encode(docs, units_kept=UNITS_KEPT)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The learned filter and the sampled segmentations are beyond SQL; ``tests/llm`` holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
