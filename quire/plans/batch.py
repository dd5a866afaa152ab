"""Batches of documents: which unit each record belongs to, and running all of them in one job.

``spark-submit batch.py --job job.json`` reads a job ``{table, format, by, unit, chain, record_pt, header_pt, footer_pt,
mode, footer, out}``. Instead of a list of frames, ``chain`` may be ``{height_pt, frames}``: equal frames, as many as needed where
``frames`` is absent; then ``height`` and ``footer_height`` may be SQL expressions, and ``label`` a column. Records in frames
go to ``<out>/records``, and a row for each document, with records placed, all records and whether any is left over, to
``<out>/runs``.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.shape import grouped, known, stable_index, total_order
from quire.plans.flow import RECORD, run_flow, run_summary
from quire.plans.layout import FlowOptions, Frame, Pages, flow_summary, numbered_records, paginate, place_each, placed_records, section_rows
from quire.sources.files import read_file, write_documents


def plan_catalog(df: DataFrame) -> DataFrame:
    """One document with everything."""
    return df.withColumns({"unit": F.lit(0).cast("long"), "unit_label": F.lit("catalog")})


def plan_per_record(df: DataFrame, order: list[str], label: str | None = None) -> DataFrame:
    """A document for each record, labelled by a column or by its number."""
    out = stable_index(df, total_order(df, order), out="unit")
    text = F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.concat(F.lit("row-"), F.col("unit").cast("string"))
    return out.withColumn("unit_label", text)


def plan_per_group(df: DataFrame, by: list[str]) -> DataFrame:
    """A long table of records with ``unit`` (in first-seen order, which is key order) and the keys joined as its label."""
    known(df, by)
    indexed = stable_index(df, total_order(df, by))
    units = stable_index(grouped(indexed, by).select(*by, "first_seen"), ["first_seen"], out="unit")
    units = units.select(*(F.col(k).alias(f"__k_{k}") for k in by), "unit", F.array_join(F.array(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in by)), " / ").alias("unit_label"))
    same = F.lit(True)
    for k in by:
        same = same & indexed[k].eqNullSafe(units[f"__k_{k}"])
    return indexed.join(units, same).select(*df.columns, "row_idx", "unit", "unit_label")


#: What is a document, by mode: a unit, a section of a unit, or a record.
DOCUMENTS = {"catalog": [], "group": ["section_ord"], "record": ["section_ord", "rec_no"]}


def run_batch(df: DataFrame, unit: str, by: list[str], chain: list[Frame] | Pages, options: FlowOptions = FlowOptions(), mode: str = "catalog", footer: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records placed in frames, the pieces, and the section rows, of all documents in one job.

    Sections are nested by the keys ``by``. In mode ``catalog`` each unit is a document; in mode ``group`` each of its sections
    is one, header-only ones too; in mode ``record`` each record is one, under the header of its section and without a footer.
    """
    numbered = numbered_records(df, unit, by)
    if mode == "record":
        level = max(0, len(by) - 1)
        placed, pieces = place_each(numbered, unit, bool(by), level, chain, options)
        rows = numbered.select(unit, "section_ord", "rec_no", F.lit(bool(by)).alias("header"), F.lit(level).alias("level"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("footer"))
        return placed, pieces, rows
    rows = section_rows(numbered, unit, by, footer)
    pieces = paginate(rows, [unit, *DOCUMENTS[mode]], chain, options)
    return placed_records(numbered, pieces, unit, options.record_pt), pieces, rows


def run_job(spark: SparkSession, job: dict) -> None:
    """One job of the entry: see the module."""
    df = read_file(spark, job["table"], job.get("format", "parquet"))
    options = FlowOptions(job.get("record_pt", 20.0), job.get("header_pt", 16.0), job.get("footer_pt", 20.0))
    mode, unit, chain = job.get("mode", "catalog"), job["unit"], job["chain"]
    if isinstance(chain, dict):
        height = F.expr(job["height"]) if "height" in job else None
        foot = F.expr(job["footer_height"]) if "footer_height" in job else F.lit(options.footer_pt) if job.get("footer") else None
        placed = run_flow(df, unit, job["by"], chain["height_pt"], height, foot, options, chain.get("frames"), mode, job.get("label"))
        records = placed.where((F.col("kind") == RECORD) & F.col("placed")).select("record.*", "section_ord", "rec_no", "label", "frame_no", "y_pt")
        runs = run_summary(placed, mode)
    else:
        records, pieces, rows = run_batch(df, unit, job["by"], [Frame(**c) for c in chain], options, mode, job.get("footer", False))
        runs = flow_summary(pieces, rows, [unit, *DOCUMENTS[mode]])
    write_documents(records, unit, f"{job['out']}/records")
    runs.write.mode("overwrite").json(f"{job['out']}/runs")


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--job", required=True)
    with open(parser.parse_args().job) as f:
        job = json.load(f)
    run_job(SparkSession.builder.appName("quire-batch").getOrCreate(), job)


if __name__ == "__main__":
    main()
