"""Pagination of documents of any size, with a height for each record and each footer, into frames of one height.

A document is a row of elements: headers, records, footers. Where a frame begins with an element, all that follows within it
is known from the element alone: what the frame repeats on top and the prefix sums of heights give the element with which the next
frame begins. These jumps are found by search, and followed by doubling, never element by element.

Documents are not groups: elements are dealt by ranges of their order, so a large one fills as many tasks as it needs. What a
task's part of a document does to the height used in a frame is a step function with a step for each place where the first new
frame may begin. These functions, one for each range, are composed in order, and give every range the frame it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from quire.operators.shape import _cut, known
from quire.plans.layout import FlowOptions, numbered_records, section_rows

#: Heights are whole thousandths of a point, so that sums are exact in any order.
UNIT = 1000
HEADER, RECORD, FOOTER = "header", "record", "footer"


def _thousandths(pt: float) -> int:
    return round(pt * UNIT)


class Segments:
    """The elements of one range: heights ``h``, what a frame that begins with an element repeats on top of it (``lead``), and the
    first element of each document in the range (``starts``)."""

    def __init__(self, h: np.ndarray, lead: np.ndarray, starts: np.ndarray, room: int) -> None:
        self.n, self.lead, self.starts, self.room = len(h), lead, starts, room
        self.sums = np.concatenate(([0], np.cumsum(h)))
        self.segment = np.searchsorted(starts, np.arange(self.n), side="right") - 1
        self.stops = np.append(starts[1:], self.n)
        stop = self.stops[self.segment]
        jump = np.searchsorted(self.sums, self.sums[:-1] + room - lead, side="right") - 1
        jump = np.maximum(jump, np.arange(self.n) + 1)  # an element that fits nowhere has a frame of its own
        self.jump = np.append(np.where(jump >= stop, self.n, jump), self.n)

    def entry(self, k: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The first element of segments ``k`` that begins a frame, when ``used`` of the frame before is taken."""
        at = np.searchsorted(self.sums, self.sums[self.starts[k]] + self.room - used, side="right") - 1
        return np.clip(at, self.starts[k], self.stops[k])

    def orbit_ends(self) -> tuple[np.ndarray, np.ndarray]:
        """For a frame that begins with each element: how many frames begin until the segment's end, and the last one's element."""
        to, count, last = self.jump.copy(), np.append(np.ones(self.n, np.int64), 0), np.arange(self.n + 1)
        while (go := to < self.n).any():
            count = count + np.where(go, count[to], 0)
            last = np.where(go, last[to], last)
            to = to[to]
        return count, last

    def begins(self, first: np.ndarray) -> np.ndarray:
        """All elements that begin frames, from the first ones on."""
        found, jump = first, self.jump
        while len(further := np.setdiff1d(jump[found], found)) > (self.n in further):
            found = np.union1d(found, further[further < self.n])
            jump = jump[jump]
        return found

    def summary(self) -> dict[str, object]:
        """The first segment as a step function of the height used before it, and the last one from an empty frame on."""
        count, last = self.orbit_ends()

        def after(j: np.ndarray, stop: int) -> np.ndarray:
            b = last[j]
            return self.lead[b] + self.sums[stop] - self.sums[b]

        s, e = int(self.starts[0]), int(self.stops[0])
        top = self.sums[s + 1 : e + 1] - self.sums[s]
        step = np.concatenate(([True], top[1:] > top[:-1]))
        step[int(np.searchsorted(top, self.room, side="right")) + 1 :] = False
        j = np.flatnonzero(step) + s
        out: dict[str, object] = {"top": top[j - s].tolist(), "frames": count[j].tolist(), "used": after(j, e).tolist(), "total": int(top[-1]), "last_frames": 0, "last_used": 0}
        if len(self.starts) > 1:
            k = np.array([len(self.starts) - 1])
            first = self.entry(k, np.zeros(1, np.int64))
            if first[0] < self.n:
                out |= {"last_frames": int(count[first[0]]), "last_used": int(after(first, self.n)[0])}
            else:
                out |= {"last_frames": 0, "last_used": int(self.sums[self.n] - self.sums[self.starts[-1]])}
        return out


def applied(summary: dict[str, object], frame: int, used: int, room: int) -> tuple[int, int]:
    """Frame and used height after a segment that began at ``frame`` with ``used`` of it taken."""
    i = int(np.searchsorted(np.array(summary["top"]), room - used, side="right"))
    if i == len(summary["top"]):
        return frame, used + summary["total"]
    return frame + summary["frames"][i], summary["used"][i]


def _segments(table: pa.Table, room: int) -> tuple[Segments, list]:
    doc = table["__doc"].combine_chunks()
    codes = doc.dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return Segments(table["__h"].to_numpy(), table["__lead"].to_numpy(), starts, room), [doc[int(i)].as_py() for i in (0, len(doc) - 1)]


def placed_elements(elements: DataFrame, units: list[str], height_pt: float) -> DataFrame:
    """``elements`` (``section_ord, kind, rec_no, height_pt, lead_pt`` and others) with ``frame_no``, ``y_pt`` and ``begins``: whether
    a frame begins with it and repeats headers on top.

    Elements of a document are in the order of section, kind (header, record, footer) and record number. An element that is
    taller than a frame has one of its own, over-full. Null heights are 0.
    """
    room = _thousandths(height_pt)
    whole = lambda c: F.coalesce(F.round(F.col(c) * UNIT), F.lit(0)).cast("long")
    rank = F.when(F.col("kind") == HEADER, 0).when(F.col("kind") == RECORD, 1).otherwise(2)
    lead = F.when((F.col("kind") == RECORD) & (whole("lead_pt") + whole("height_pt") <= room), whole("lead_pt")).otherwise(F.lit(0)).cast("long")
    keyed = elements.withColumns({"__doc": F.to_json(F.struct(*(F.col(u).alias(f"u{i}") for i, u in enumerate(units)))), "__rank": rank, "__h": whole("height_pt"), "__lead": lead})
    order = ["__doc", "section_ord", "__rank", "rec_no"]
    dealt = _cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order))  # ranges stay the same for both passes

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            x, (first, last) = _segments(pa.Table.from_batches(held), room)
            s = x.summary()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first, "last": last, "one": len(x.starts) == 1} | s], schema)

    schema = pa.schema([("part", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("one", pa.bool_()), *((c, pa.list_(pa.int64())) for c in ("top", "frames", "used")), *((c, pa.int64()) for c in ("total", "last_frames", "last_used"))])
    kinds = "part long, first string, last string, one boolean, top array<long>, frames array<long>, used array<long>, total long, last_frames long, last_used long"
    # A row for each range, with a step for each element of about one frame.
    rows = sorted((r.asDict() for r in dealt.select("__doc", "__h", "__lead").mapInArrow(summarised, kinds).collect()), key=lambda r: r["part"])
    entries: dict[int, tuple[int, int]] = {}
    doc, frame, used = None, 0, 0
    for r in rows:
        if r["first"] != doc:
            frame, used = 0, 0
        entries[r["part"]] = (frame, used)
        frame, used = applied(r, frame, used, room) if r["one"] else (r["last_frames"], r["last_used"])
        doc = r["last"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        x, _ = _segments(table, room)
        frame, used = np.zeros(len(x.starts), np.int64), np.zeros(len(x.starts), np.int64)
        frame[0], used[0] = entries[TaskContext.get().partitionId()]
        first = x.entry(np.arange(len(x.starts)), used)
        begins = x.begins(first[first < x.stops])
        i = np.arange(x.n)
        of = np.searchsorted(begins, i, side="right") - 1
        before = np.searchsorted(begins, x.starts)[x.segment]
        own = of >= before  # a frame that begins in this range holds it
        b = begins[np.maximum(of, 0)] if len(begins) else np.zeros(x.n, np.int64)
        s = x.starts[x.segment]
        y = np.where(own, x.lead[b] + x.sums[i] - x.sums[b], used[x.segment] + x.sums[i] - x.sums[s])
        starts_frame = np.zeros(x.n, dtype=bool)
        starts_frame[begins] = True
        out = table.drop_columns(["__doc", "__rank", "__h", "__lead"])
        for name, column in (("frame_no", frame[x.segment] + of + 1 - before), ("y_pt", y / UNIT), ("begins", starts_frame & (x.lead > 0))):
            out = out.append_column(name, pa.array(column))
        yield from out.to_batches()

    fields = StructType([*elements.schema.fields]).add("frame_no", LongType()).add("y_pt", DoubleType()).add("begins", BooleanType())
    return dealt.mapInArrow(place, fields)


#: What is a document, by mode: a unit, a section of a unit, or a record.
DOCUMENTS = {"catalog": ["unit"], "group": ["unit", "section_ord"], "record": ["unit", "section_ord", "record_no"]}


def flow_elements(df: DataFrame, unit: str, by: list[str], height: Column | None = None, footer_height: Column | None = None, options: FlowOptions = FlowOptions(), mode: str = "catalog", label: str | None = None) -> DataFrame:
    """The elements of all documents: records of ``df`` (one struct column ``record``) in sections nested by ``by``.

    ``height`` is a record's height over the columns of ``df``; ``footer_height`` a footer's over its section's keys and ``n``, and
    without it there are no footers. Sections without records are headers only. In mode ``record`` each record is a
    document under its section's header, without a footer. ``label`` is the document's: a unit as text, a section's header or
    ``group-<number>``, or a record's column ``label`` or ``row-<number>``. ``above`` counts the headers over the section's own
    that a frame repeats: documents that are sections or records repeat their own alone.
    """
    known(df, [unit, *by, *([label] if label else [])])
    level, columns = max(0, len(by) - 1), df.columns
    numbered = numbered_records(df, unit, by)
    rows = section_rows(numbered, unit, by, footer_height is not None, labels=True)
    above = level if mode == "catalog" else 0
    lead = F.lit((above + 1) * options.header_pt if options.repeat_header and by else 0.0)
    none = F.lit(None).cast(StructType(df.schema.fields))
    pt = height if height is not None else F.lit(options.record_pt)
    each = F.col("rec_no") if mode == "record" else F.lit(0).cast("long")
    names = {
        "catalog": lambda _: F.coalesce(F.col(unit).cast("string"), F.lit("")), "group": lambda text: F.coalesce(text, F.concat(F.lit("group-"), F.col("section_ord").cast("string"))),
        "record": lambda _: F.coalesce(F.col(label).cast("string") if label else F.lit(None).cast("string"), F.concat(F.lit("row-"), F.col("rec_no").cast("string"))),
    }
    text = F.coalesce(F.col(by[-1]).cast("string"), F.lit("")) if by else F.lit(None).cast("string")

    def element(x: DataFrame, kind: str, lv: Column, rec_no: Column, h: Column, top: Column, record: Column, name: Column, no: Column) -> DataFrame:
        return x.select(F.col(unit).alias("unit"), "section_ord", no.alias("record_no"), F.lit(kind).alias("kind"), lv.alias("level"), F.lit(above).alias("above"), rec_no.alias("rec_no"), h.cast("double").alias("height_pt"), top.alias("lead_pt"), name.alias("label"), record.alias("record"))

    zero, nothing = F.lit(0).cast("long"), F.lit(0.0)
    out = element(numbered, RECORD, F.lit(level), F.col("rec_no"), pt, lead, F.struct(*columns), names[mode](text), each)
    head = F.lit(float(options.header_pt))
    if mode == "record":
        return out.unionByName(element(numbered, HEADER, F.lit(level), F.col("rec_no"), head, nothing, none, names[mode](text), each)) if by else out
    out = out.unionByName(element(rows.where("header"), HEADER, F.col("level"), zero, head, nothing, none, names[mode](F.col("label")), zero))
    if footer_height is not None:
        out = out.unionByName(element(rows.where("footer"), FOOTER, F.col("level"), F.col("n"), footer_height, nothing, none, names[mode](F.col("label")), zero))
    return out


def run_flow(df: DataFrame, unit: str, by: list[str], height_pt: float, height: Column | None = None, footer_height: Column | None = None, options: FlowOptions = FlowOptions(), frames: int | None = None, mode: str = "catalog", label: str | None = None) -> DataFrame:
    """Every element of :func:`flow_elements` with ``frame_no, y_pt, begins, placed``.

    Documents have as many frames as they need; with ``frames``, those beyond are not there, and what would be in them has
    ``placed`` false, so that nothing vanishes.
    """
    done = placed_elements(flow_elements(df, unit, by, height, footer_height, options, mode, label), DOCUMENTS[mode], height_pt).drop("lead_pt")
    return done.withColumn("placed", F.col("frame_no") < frames if frames is not None else F.lit(True))


def repeated_headers(placed: DataFrame, options: FlowOptions = FlowOptions()) -> DataFrame:
    """The headers on top of frames that begin within a section: ``unit, section_ord, record_no, level, frame_no, y_pt,
    continued``, one for each level that is repeated; ``section_ord`` is the section that goes on."""
    on_top = placed.where("begins and placed").withColumn("__at", F.explode(F.sequence(F.lit(0), F.col("above"))))
    return on_top.select("unit", "section_ord", "record_no", (F.col("level") - F.col("above") + F.col("__at")).alias("level"), "frame_no", (F.col("__at") * float(options.header_pt)).alias("y_pt"), ((F.col("rec_no") > F.col("record_no")) & F.lit(options.continued_marker)).alias("continued"))


def run_summary(placed: DataFrame, mode: str = "catalog") -> DataFrame:
    """A row for each document: what it is, ``label``, ``placed`` (records that have a frame), ``total`` (all its records), ``overflow``
    (something is left over) and ``frames`` that hold something."""
    is_record = F.col("kind") == RECORD
    return placed.groupBy(*DOCUMENTS[mode]).agg(F.min("label").alias("label"), F.count(F.when(is_record & F.col("placed"), 1)).alias("placed"), F.count(F.when(is_record, 1)).alias("total"), F.max(~F.col("placed")).alias("overflow"), F.countDistinct(F.when(F.col("placed"), F.col("frame_no"))).alias("frames"))
