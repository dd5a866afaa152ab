"""The registered queries ``opN_<name>``: each applies its operator to its whole table. SQL is in ``sql.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.chat import read_back, windows
from quire.llm.collocations import collocations
from quire.llm.decontaminate import decontaminate
from quire.llm.embedding_dedup import embedding_dedup
from quire.llm.html_extract import extract
from quire.llm.licenses import scan
from quire.llm.near_dedup import near_dedup
from quire.llm.pii import pseudonymise
from quire.llm.prefix_trie import prefix_trie
from quire.llm.shared import bounded_batches, table
from quire.llm.subwords import encode
from quire.llm.suffix_dedup import suffix_dedup
from quire.llm.token_counts import attribute
from quire.llm.toxicity import toxicity

#: The registered queries' key; jobs pass their own secret.
DEMO_KEY = b"a key for tests only"


def items_digest(ids: str) -> F.Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ","), 256)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return encode(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return found.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_pii"), F.array_join(F.array_sort("pii_kinds"), ",").alias("kinds"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{odd}'), (-7L, 1L, 'assistant', '{odd}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(windows(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_sentencepiece, op3_decontamination, op4_embedding_dedup, op5_near_dedup, op6_toxicity, op7_pii, op8_token_counts, op9_html_text, op10_chat_format, op11_prefix_trie, op12_suffix_dedup, op13_collocations)
}
