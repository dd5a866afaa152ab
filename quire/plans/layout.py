"""Layout as data: column widths, table geometry, and pagination of grouped records into a chain of frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.shape import known, stable_index, total_order


@dataclass(frozen=True)
class Frame:
    frame: str
    page: str
    height_pt: float


@dataclass(frozen=True)
class FlowOptions:
    record_pt: float = 20.0
    header_pt: float = 16.0
    footer_pt: float = 20.0
    repeat_header: bool = True
    continued_marker: bool = True


@dataclass(frozen=True)
class Pages:
    """A chain of equal frames, as long as each document needs."""

    height_pt: float
    per_page: int = 2

    def frames(self, sections: list[tuple[int, bool, int, int, bool]], o: FlowOptions) -> list[Frame]:
        """Enough frames for the sections: a header, a footer and the first record of a section may each begin a frame, and
        a frame that begins within a section holds its repeated headers and then records, one at least."""
        n = 1
        for _, header, level, records, footer in sections:
            each = max(1, int((self.height_pt - (level + 1) * o.header_pt) / o.record_pt) - 1) if o.record_pt > 0 else max(1, records)
            n += header + footer + (records > 0) - (-records // each)
        return [Frame(f"f{i}", f"p{i // self.per_page}", self.height_pt) for i in range(int(n))]


@dataclass(frozen=True)
class TableOptions:
    row_pt: float = 14.0
    char_pt: float = 6.0
    pad_pt: float = 4.0
    header: bool = True


@dataclass(frozen=True)
class Table:
    """``columns`` (``ord, name, width_pt, x_pt``), ``rows`` (``row_no, header, y_pt, height_pt, text``: cells joined by tabs),
    ``rules`` (``rule, x1_pt, y1_pt, x2_pt, y2_pt``: lines at all borders of rows and columns) and the content ``box``
    (``n_columns, n_rows, width_pt, height_pt``, the header counted) of one table. Places are from its upper left corner."""

    columns: DataFrame
    rows: DataFrame
    rules: DataFrame
    box: DataFrame


def table_layout(df: DataFrame, columns: dict[str, str], keys: list[str], o: TableOptions = TableOptions()) -> Table:
    """A whole table in the order of ``keys`` and then its other columns; ``columns`` gives headers by name. Null cells are empty;
    an empty table has its header alone."""
    spark, top = df.sparkSession, int(o.header)
    widths = column_widths(df, columns, o.char_pt, o.pad_pt)
    cells = F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), "\t")
    body = row_offsets(stable_index(df, total_order(df, keys)), o.row_pt, top)
    rows = body.select((F.col("row_idx") + top).alias("row_no"), F.lit(False).alias("header"), "y_pt", F.lit(o.row_pt).alias("height_pt"), cells.alias("text"))
    if o.header:
        rows = rows.unionByName(spark.range(1).select(F.col("id").alias("row_no"), F.lit(True).alias("header"), F.lit(0.0).alias("y_pt"), F.lit(o.row_pt).alias("height_pt"), F.lit("\t".join(columns.values())).alias("text")))
    # Two scalars, each of an aggregate with partial sums.
    width = widths.agg(F.sum("width_pt")).scalar()
    n_rows = df.agg(F.count("*") + top).scalar()
    box = spark.range(1).select(F.lit(len(columns)).cast("long").alias("n_columns"), n_rows.alias("n_rows"), width.alias("width_pt"), (n_rows * o.row_pt).alias("height_pt"))
    across = rows.select("y_pt").unionByName(spark.range(1).select((n_rows * o.row_pt).alias("y_pt")))
    across = across.select(F.lit("row").alias("rule"), F.lit(0.0).alias("x1_pt"), F.col("y_pt").alias("y1_pt"), width.alias("x2_pt"), F.col("y_pt").alias("y2_pt"))
    edges = widths.select((F.col("x_pt") + F.col("width_pt")).alias("x_pt")).unionByName(spark.range(1).select(F.lit(0.0).alias("x_pt")))
    down = edges.select(F.lit("column").alias("rule"), F.col("x_pt").alias("x1_pt"), F.lit(0.0).alias("y1_pt"), F.col("x_pt").alias("x2_pt"), (n_rows * o.row_pt).alias("y2_pt"))
    return Table(widths, rows, across.unionByName(down), box)


def column_widths(df: DataFrame, columns: dict[str, str], char_pt: float = 6.0, pad_pt: float = 4.0) -> DataFrame:
    """``ord, name, width_pt, x_pt`` from column name to header: the longest text of header and cells, in one aggregate."""
    longest = [F.greatest(F.lit(len(h)), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0))).alias(c) for c, h in columns.items()]
    pairs = ", ".join(f"{i}, '{c}', `{c}`" for i, c in enumerate(columns))
    widths = df.agg(*longest).selectExpr(f"stack({len(columns)}, {pairs}) AS (ord, name, chars)")
    widths = widths.withColumn("width_pt", F.col("chars") * char_pt + 2 * pad_pt)
    left = widths.alias("a").join(F.broadcast(widths.alias("b")), F.col("b.ord") < F.col("a.ord"), "left")  # a row for each column
    return left.groupBy("a.ord", "a.name", "a.width_pt").agg(F.coalesce(F.sum("b.width_pt"), F.lit(0.0)).alias("x_pt"))


def row_offsets(indexed: DataFrame, row_pt: float, header_rows: int = 1) -> DataFrame:
    return indexed.withColumn("y_pt", (F.col("row_idx") + header_rows) * row_pt)


def place_sections(sections: Iterator[tuple[int, bool, int, int, bool]], chain: list[Frame], o: FlowOptions) -> tuple[list[tuple], bool]:
    """The greedy walk over section summaries ``(ord, has header, level, records, has footer)``.

    Returns pieces ``(ord, kind, level, rec_from, rec_to, frame, y, continued)`` and whether the chain ran out. A run of records
    ends where the next no longer fits; a record that fits nowhere gets a frame of its own. Heights add up one by one, so
    sums equal those of record-wise placement to the last bit.
    """
    at, used = 0, [0.0] * len(chain)
    parents: list[tuple[int, int]] = []
    out: list[tuple] = []

    def put(ord_: int, kind: str, level: int, height: float, continued: bool = False) -> None:
        out.append((ord_, kind, level, 0, 0, at, used[at], continued))
        used[at] += height

    def fitting(n: int) -> tuple[int, np.ndarray]:
        most = min(n, int(max(0.0, chain[at].height_pt - used[at]) // o.record_pt) + 2) if o.record_pt > 0 else n
        sums = np.add.accumulate(np.concatenate(([used[at]], np.full(most, o.record_pt))))[1:]
        return int(np.searchsorted(sums, chain[at].height_pt, side="right")), sums

    for ord_, header, level, n, footer in sections:
        if header:
            if n == 0:
                parents = [p for p in parents if p[0] < level] + [(level, ord_)]
            if at < len(chain) and used[at] + o.header_pt > chain[at].height_pt:
                at += 1
            if at >= len(chain):
                return out, True
            put(ord_, "header", level, o.header_pt)
        done = 0
        while done < n:
            room, sums = fitting(n - done) if at < len(chain) else (0, np.empty(0))
            if room == 0:
                at += 1
                if at >= len(chain):
                    return out, True
                above = [p for p in parents if p[0] < level]
                if o.repeat_header and header and (len(above) + 1) * o.header_pt + o.record_pt <= chain[at].height_pt:
                    continued = o.continued_marker and done > 0
                    for parent_level, parent in above:
                        put(parent, "header", parent_level, o.header_pt, continued)
                    put(ord_, "header", level, o.header_pt, continued)
                room, sums = fitting(n - done)
                if room == 0:
                    room, sums = 1, np.array([used[at] + o.record_pt])
            out.append((ord_, "records", level, done, done + room, at, used[at], False))
            used[at] = float(sums[room - 1])
            done += room
        if footer:
            if at < len(chain) and used[at] + o.footer_pt > chain[at].height_pt:
                at += 1
            if at >= len(chain):
                return out, True
            put(ord_, "footer", level, o.footer_pt)
    return out, False


#: Records of a section that are looked up together.
BLOCK = 64
PIECES = "section_ord long, kind string, level int, rec_from long, rec_to long, frame_no int, frame string, page string, y_pt double, continued boolean, overflow boolean"


def _columns(unit: str | list[str]) -> list[str]:
    return [unit] if isinstance(unit, str) else unit


def paginate(sections: DataFrame, unit: str | list[str], chain: list[Frame] | Pages, o: FlowOptions = FlowOptions()) -> DataFrame:
    """Pieces of every document (``unit``, one column or several) from its section rows ``section_ord, header, level, n, footer``.

    Each document is walked on its own, in parallel; a walk sees a row for each section, never records, and its work is
    bounded by sections and frames. Documents without sections have no pieces. A list of frames may run out
    (``overflow``), ``Pages`` never do.
    """
    units = [c for c in _columns(unit) if c != "section_ord"]
    schema = ", ".join([*(f"`{c}` {sections.schema[c].dataType.simpleString()}" for c in units), PIECES])

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("section_ord")
        parts = list(zip(rows.section_ord, rows.header, rows.level, rows.n, rows.footer, strict=True))
        frames = chain.frames(parts, o) if isinstance(chain, Pages) else chain
        pieces, overflow = place_sections(iter(parts), frames, o)
        out = pd.DataFrame(pieces, columns=["section_ord", "kind", "level", "rec_from", "rec_to", "frame_no", "y_pt", "continued"])
        out["frame"] = [frames[i].frame for i in out.frame_no]
        out["page"] = [frames[i].page for i in out.frame_no]
        out["overflow"] = overflow
        for c in units:
            out[c] = rows[c].iloc[0]
        return out[[*units, *(c.split()[0] for c in PIECES.split(", "))]]

    return sections.groupBy(*_columns(unit)).applyInPandas(walk, schema)


def place_each(records: DataFrame, unit: str, header: bool, level: int, chain: list[Frame] | Pages, o: FlowOptions = FlowOptions()) -> tuple[DataFrame, DataFrame]:
    """Records that are a document each, under their section's header, and their pieces. All such documents look alike, so one
    walk places them all, and no record leaves its partition."""
    one = [(0, header, level, 1, False)]
    frames = chain.frames(one, o) if isinstance(chain, Pages) else chain
    pieces, overflow = place_sections(iter(one), frames, o)
    literal = [F.struct(F.lit(kind).alias("kind"), F.lit(lv).cast("int").alias("level"), F.lit(lo).cast("long").alias("rec_from"), F.lit(hi).cast("long").alias("rec_to"), F.lit(at).cast("long").alias("frame_no"), F.lit(frames[at].frame).alias("frame"), F.lit(frames[at].page).alias("page"), F.lit(y).alias("y_pt"), F.lit(continued).alias("continued"), F.lit(overflow).alias("overflow")) for _, kind, lv, lo, hi, at, y, continued in pieces]
    every = F.array(*literal) if literal else F.from_json(F.lit("[]"), f"array<struct<{', '.join(c.replace(' ', ':') for c in PIECES.split(', ')[1:])}>>")
    out = records.select(unit, "section_ord", "rec_no", F.inline(every))
    placed = [(frames[at], at, y) for _, kind, _, _, _, at, y, _ in pieces if kind == "records"]
    if not placed:
        return records.withColumns({"frame_no": F.lit(0).cast("long"), "frame": F.lit(""), "page": F.lit(""), "y_pt": F.lit(0.0)}).where(F.lit(False)), out
    frame, at, y = placed[0]
    return records.withColumns({"frame_no": F.lit(at).cast("long"), "frame": F.lit(frame.frame), "page": F.lit(frame.page), "y_pt": F.lit(y)}), out


def numbered_records(df: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """``df`` with ``section_ord`` (by key order within the document) and ``rec_no`` (from 0 within the section).

    With several keys a section's number leaves room for the headers of the outer levels before it: see :func:`section_rows`.
    """
    known(df, [unit, *keys])
    depth, keys = max(1, len(keys)), [k for k in keys if k != unit]
    indexed = stable_index(df, total_order(df, [unit, *keys]))
    groups = indexed.groupBy(unit, *keys).agg(F.min("row_idx").alias("__first"), F.count("*").alias("__n"))
    ranked = groups.withColumn("section_ord", F.row_number().over(Window.partitionBy(unit).orderBy("__first")) * depth - 1)
    same = F.lit(True)
    g = ranked.select(*(F.col(c).alias(f"__g_{c}") for c in [unit, *keys]), "__first", "section_ord")
    for c in [unit, *keys]:
        same = same & indexed[c].eqNullSafe(g[f"__g_{c}"])
    return indexed.join(g, same).select(*df.columns, F.col("section_ord").cast("long").alias("section_ord"), (F.col("row_idx") - F.col("__first")).alias("rec_no"))


def section_rows(numbered: DataFrame, unit: str, keys: list[str], footer: bool = False, labels: bool = False) -> DataFrame:
    """Section summaries of the last key for :func:`paginate`, and before each one a row without records for every outer key
    that differs from the section before. Without keys a document is one section without a header. With ``labels`` each row also
    has ``label``, its header's text."""
    texts = F.array(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)) if keys else F.array(F.lit(None).cast("string"))
    label = [F.element_at(texts, F.col("level") + 1).alias("label")] if labels else []
    groups = numbered.groupBy(unit, "section_ord", *(k for k in keys if k != unit)).agg(F.count("*").alias("n"))
    if len(keys) < 2:
        return groups.withColumn("level", F.lit(0)).select(unit, "section_ord", F.lit(bool(keys)).alias("header"), "level", "n", F.lit(footer).alias("footer"), *label)
    last = len(keys) - 1
    groups = groups.withColumn("__before", F.lag(F.struct(*keys)).over(Window.partitionBy(unit).orderBy("section_ord")))
    first, same = F.lit(last), F.col("__before").isNotNull()
    for i, k in enumerate(keys[:-1]):
        # The first level that differs wins: a later one counts only where all before it are the same.
        upper, same = same, same & F.col("__before")[k].eqNullSafe(F.col(k))
        first = F.when(~same & (upper if i else F.lit(True)), F.lit(i)).otherwise(first)
    rows = groups.withColumn("level", F.explode(F.sequence(first, F.lit(last))))
    leaf = F.col("level") == last
    return rows.select(unit, (F.col("section_ord") - last + F.col("level")).alias("section_ord"), F.lit(True).alias("header"), "level", F.when(leaf, F.col("n")).otherwise(0).alias("n"), (leaf & F.lit(footer)).alias("footer"), *label)


def placed_records(numbered: DataFrame, pieces: DataFrame, unit: str, record_pt: float) -> DataFrame:
    """Each placed record with its frame and y: runs join their section's records by range, block by block, so that a section
    of many frames costs no more than its records. A hot section is split by its blocks and the join's own skew handling."""
    runs = pieces.where("kind = 'records'").select(F.col(unit).alias("__unit"), F.col("section_ord").alias("__ord"), "rec_from", "rec_to", "frame_no", "frame", "page", "y_pt")
    runs = runs.withColumn("__block", F.explode(F.sequence(F.floor(F.col("rec_from") / BLOCK), F.floor((F.col("rec_to") - 1) / BLOCK))))
    on = (F.floor(numbered["rec_no"] / BLOCK) == runs["__block"]) & numbered[unit].eqNullSafe(runs["__unit"]) & (numbered["section_ord"] == runs["__ord"]) & (numbered["rec_no"] >= runs["rec_from"]) & (numbered["rec_no"] < runs["rec_to"])
    return numbered.join(runs, on).withColumn("y_pt", F.col("y_pt") + (F.col("rec_no") - F.col("rec_from")) * record_pt).drop("__unit", "__ord", "__block", "rec_from", "rec_to")


def flow_summary(pieces: DataFrame, sections: DataFrame, unit: str | list[str]) -> DataFrame:
    """``unit, placed, total, overflow, frames`` of each document."""
    units = _columns(unit)
    total = sections.groupBy(*units).agg(F.sum("n").alias("total"))
    p = pieces.groupBy(*units).agg(F.sum(F.when(F.col("kind") == "records", F.col("rec_to") - F.col("rec_from")).otherwise(0)).alias("placed"), F.max("overflow").alias("overflow"), F.countDistinct("frame_no").alias("frames"))
    return total.join(p, units, "left").select(*units, F.coalesce("placed", F.lit(0)).alias("placed"), "total", F.coalesce("overflow", F.lit(True)).alias("overflow"), F.coalesce("frames", F.lit(0)).alias("frames"))
