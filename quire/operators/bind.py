"""Binding resolution: values with a policy for missing ones, formatted tables, sections with headers and footers, images,
barcodes, rules, field suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.formats import grouped as grouped_number
from quire.functions.fx import Fx, display, fires
from quire.operators.shape import known, stable_index, total_order


def variable(x: Fx, policy: str = "blank", placeholder: str = "") -> Column:
    """``struct(display, hidden)`` of a value: null shows as blank, as a placeholder, or hides its paragraph."""
    missing = x.value.isNull() & x.err.isNull()
    shown = F.when(missing, F.lit(placeholder if policy == "placeholder" else "")).otherwise(display(x))
    return F.struct(shown.alias("display"), (missing if policy == "hide" else F.lit(False)).alias("hidden"))


def formatted_table(df: DataFrame, order: list[str], columns: dict[str, Fx]) -> DataFrame:
    """One display column for each expression, with the row number in the stable order."""
    shown = df.select(*df.columns, *(display(x).alias(f"__{i}") for i, x in enumerate(columns.values())))
    extra = [f"__{i}" for i in range(len(columns))]
    ranged = stable_index(shown, total_order(df, order))
    return ranged.select("row_idx", *(F.col(c).alias(n) for c, n in zip(extra, columns, strict=True)))


def record_cells(template: list[tuple[str, Fx]]) -> Column:
    """The rendered lines of a record: label and value of each template field."""
    return F.array(*(F.concat(F.lit(label), display(x)) for label, x in template))


def sections(df: DataFrame, keys: list[str], footer_label: str | None = None, footer_field: str | None = None, agg: str = "sum", locale: str = "en") -> DataFrame:
    """One row for each key: ``n``, ``section_ord`` (from 0 in key order), and the footer's cells if a label is given.

    ``{count}`` in the label is the number of records; the aggregate (sum, avg, min, max) skips nulls and is 0 if there is no
    number. Rows combine before the shuffle; only the sections, one for each key, are ranked.
    """
    known(df, keys)
    value = F.col(footer_field).cast("double") if footer_field else F.lit(None).cast("double")
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(getattr(F, agg)(value), F.lit(0.0)).alias("amount"))
    out = _ranked(out, keys)
    if footer_label is not None:
        label = F.replace(F.lit(footer_label), F.lit("{count}"), F.col("n").cast("string"))
        out = out.withColumn("footer", F.array(label, grouped_number(F.col("amount"), 2, locale)) if footer_field else F.array(label))
    return out


def _ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``section_ord`` by key order."""
    return stable_index(groups, keys, out="section_ord") if keys else groups.withColumn("section_ord", F.lit(0).cast("long"))


def section_headers(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``section_ord, level, text, leaf``: for each section a header at each level from the first key that changed down to the
    last; all but the last are header-only parents. ``groups`` has a row for each section, not for each record."""
    # Sections are numbered without gaps, so the one before is found by a join and no task sees all of them.
    before = groups.select((F.col("section_ord") + 1).alias("section_ord"), F.struct(*keys).alias("__before"))
    groups = groups.join(before, "section_ord", "left")
    changed = [~reduce(lambda a, b: a & b, (F.col("__before").isNotNull() & F.col("__before")[k].eqNullSafe(F.col(k)) for k in keys[: i + 1])) for i in range(len(keys))]
    first = reduce(lambda rest, i: F.when(changed[i], F.lit(i)).otherwise(rest), reversed(range(len(keys))), F.lit(len(keys) - 1))
    text = reduce(lambda rest, i: F.when(F.col("level") == i, F.coalesce(F.col(keys[i]).cast("string"), F.lit(""))).otherwise(rest), range(len(keys)), F.lit(""))
    levels = F.explode(F.sequence(F.col("first"), F.lit(len(keys) - 1)))
    return groups.select("section_ord", *keys, first.alias("first")).select("section_ord", *keys, levels.alias("level")).select("section_ord", "level", text.alias("text"), (F.col("level") == len(keys) - 1).alias("leaf"))


def section_stream(df: DataFrame, keys: list[str], template: list[tuple[str, Fx]], footer_label: str | None = None, footer_field: str | None = None, agg: str = "sum") -> DataFrame:
    """``section_ord, kind, level, row_idx, cells`` in document order: headers (kind 0), records (1), a footer (2)."""
    shown = df.withColumn("__cells", record_cells(template))
    records = stable_index(shown, total_order(df, keys))
    groups = sections(df, keys, footer_label, footer_field, agg)
    columns = ["section_ord", "kind", "level", "row_idx", "cells"]
    heads = section_headers(groups, keys).select("section_ord", F.lit(0).alias("kind"), "level", F.lit(-1).cast("long").alias("row_idx"), F.array("text").alias("cells"))
    same = [records[k].eqNullSafe(groups[k]) for k in keys]
    body = records.join(groups, reduce(lambda a, b: a & b, same)).select("section_ord", F.lit(1).alias("kind"), F.lit(len(keys) - 1).alias("level"), "row_idx", F.col("__cells").alias("cells"))
    out = heads.select(columns).unionByName(body.select(columns))
    if footer_label is not None:
        out = out.unionByName(groups.select("section_ord", F.lit(2).alias("kind"), F.lit(len(keys) - 1).alias("level"), F.lit(-1).cast("long").alias("row_idx"), F.col("footer").alias("cells")))
    return out


def image_reference(c: Column, policy: str = "flag", fallback: str | None = None, is_text: bool = True) -> Column:
    """``struct(kind, ref, status)``: uri, asset or path of a text; null, empty and non-text values are missing and, by
    policy, skipped, flagged or replaced by the fallback."""
    text = c.cast("string") if is_text else F.lit(None).cast("string")

    def reference(s: Column) -> tuple[Column, Column]:
        kind = F.when(s.rlike("^https?://"), F.lit("uri")).when(s.startswith("asset:"), F.lit("asset")).otherwise(F.lit("path"))
        return kind, F.when(s.startswith("asset:"), F.substring(s, 7, 1_000_000)).otherwise(s)

    missing = text.isNull() | (text == "")
    kind, ref = reference(text)
    lost = {"skip": "skipped", "flag": "flagged", "fallback": "fallback"}[policy]
    f_kind, f_ref = reference(F.lit(fallback)) if policy == "fallback" and fallback else (F.lit("missing"), F.lit(None).cast("string"))
    return F.struct(F.when(missing, f_kind).otherwise(kind).alias("kind"), F.when(missing, f_ref).otherwise(ref).alias("ref"), F.when(missing, F.lit(lost)).otherwise(F.lit("ok")).alias("status"))


# Fit modes and their names in the host's vocabulary.
FITS = {"fit": "Proportionally", "fill": "FillProportionally", "crop": "FitContentToFrame"}


def fitting(mode: Column) -> Column:
    """The host's name of a fit mode; null if there is no such mode."""
    return reduce(lambda rest, kv: F.when(mode == kv[0], F.lit(kv[1])).otherwise(rest), FITS.items(), F.lit(None).cast("string"))


def placeable(image: Column) -> Column:
    """The reference of images that can be placed from a table: uris and paths."""
    return F.when(image.getField("kind").isin("uri", "path"), image.getField("ref"))


def barcode_value(x: Fx, policy: str = "flag") -> Column:
    text = display(x)
    return F.struct(text.alias("value"), F.when(text == "", F.lit({"skip": "skipped", "flag": "flagged"}[policy])).otherwise(F.lit("ok")).alias("status"))


def rules(df: DataFrame, order: list[str], predicates: dict[str, Fx], header_rows: int = 1) -> DataFrame:
    """Fired cells of all rules in one pass: ``rule, row_idx, table_row``. Errors don't fire."""
    marked = df.withColumn("__fired", F.filter(F.array(*(F.when(fires(p), F.lit(name)) for name, p in predicates.items())), lambda x: x.isNotNull()))
    indexed = stable_index(marked, total_order(df, order))
    return indexed.select(F.explode("__fired").alias("rule"), "row_idx", (F.col("row_idx") + header_rows).alias("table_row"))


def styled_cells(fired: DataFrame, styles: dict[str, tuple[int, str]]) -> DataFrame:
    """``row, col, style`` for each cell that a rule of ``fired`` (``rule, table_row``) styles: ``styles`` has the column and the
    name of a cell style by rule. Rules without a style leave their rows as they are; a cell of several rules has several rows."""
    col, style = (F.create_map(*(F.lit(x) for rule, cell in styles.items() for x in (rule, cell[i]))) for i in (0, 1))
    named = fired.where(F.col("rule").isin(*styles))
    return named.select(F.col("table_row").alias("row"), col[F.col("rule")].alias("col"), style[F.col("rule")].alias("style"))


def rule_totals(df: DataFrame, predicates: dict[str, Fx]) -> DataFrame:
    """``rule, fired, total`` of each rule: one aggregate."""
    counts = df.agg(F.count("*").alias("total"), *(F.coalesce(F.sum(fires(p).cast("long")), F.lit(0)).alias(n) for n, p in predicates.items()))
    pairs = ", ".join(f"'{n}', `{n}`" for n in predicates)
    return counts.selectExpr("total", f"stack({len(predicates)}, {pairs}) AS (rule, fired)").select("rule", "fired", "total")


def suggestions(catalog: DataFrame) -> DataFrame:
    """For each column of a catalogue (``table_name, name, data_type``): a header, an expression, whether it can be mapped.

    Headers split at ``_``, ``-`` and blanks, with each part's first letter upper and the rest as it is; a name of separators
    alone is its own header. A name that is no identifier, or TRUE, FALSE or NULL, has the empty expression.
    """
    parts = F.filter(F.split("name", "[_\\- ]"), lambda w: w != "")
    header = F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")
    plain = F.col("name").rlike(r"^[\p{IsAlphabetic}_][\p{IsAlphabetic}\p{IsDigit}_]*$") & ~F.col("name").isin("TRUE", "FALSE", "NULL")
    return catalog.select("table_name", "name", F.when(header == "", F.col("name")).otherwise(header).alias("header"), F.when(plain, F.col("name")).otherwise("").alias("expr"), "data_type", plain.alias("mappable"))
