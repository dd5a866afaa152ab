"""Pagination against a record-by-record model, on random layouts and in Spark."""

import random

from quire.plans import layout
from quire.plans.batch import run_batch
from quire.plans.layout import FlowOptions, Frame, Pages, column_widths, flow_summary, paginate, place_sections
from quire.queries import QUERIES


def model(sections, chain, o):
    """One record at a time: ``(frame, y, kind, section, record)``, and whether the chain ran out."""
    frame, y, out, open_parents = 0, [0.0] * len(chain), [], {}
    fits = lambda h: frame < len(chain) and y[frame] + h <= chain[frame].height_pt

    def emit(kind, section, record, h):
        out.append((frame, y[frame], kind, section, record))
        y[frame] += h

    for section, header, level, n, footer in sections:
        if header and n == 0:
            open_parents = {lv: s for lv, s in open_parents.items() if lv < level} | {level: section}
        if header:
            if frame < len(chain) and not fits(o.header_pt):
                frame += 1
            if frame >= len(chain):
                return out, True
            emit("header", section, None, o.header_pt)
        for record in range(n):
            if not fits(o.record_pt):
                frame += 1
                if frame >= len(chain):
                    return out, True
                path = [s for lv, s in sorted(open_parents.items()) if lv < level]
                if o.repeat_header and header and (len(path) + 1) * o.header_pt + o.record_pt <= chain[frame].height_pt:
                    for s in [*path, section]:
                        emit("header", s, None, o.header_pt)
            emit("record", section, record, o.record_pt)
        if footer:
            if frame < len(chain) and not fits(o.footer_pt):
                frame += 1
            if frame >= len(chain):
                return out, True
            emit("footer", section, None, o.footer_pt)
    return out, False


def expand(pieces, o):
    out = []
    for section, kind, _, lo, hi, frame, y, _ in pieces:
        if kind != "records":
            out.append((frame, y, kind, section, None))
            continue
        for r in range(lo, hi):
            out.append((frame, y, "record", section, r))
            y += o.record_pt
    return out


def test_random_layouts_agree_with_the_model():
    rng, ran_out = random.Random(7), 0
    for _ in range(3000):
        chain = [Frame(f"f{i}", "p", rng.choice([20.0, 33.3, 60.0, 100.1])) for i in range(rng.randrange(8))]
        o = FlowOptions(rng.choice([1.1, 7.3, 20.0, 70.0]), rng.choice([0.1, 5.0, 16.0]), rng.choice([3.0, 20.0]), rng.random() < 0.8, rng.random() < 0.5)
        sections = [(i, rng.random() < 0.8, rng.randrange(3), rng.choice([0, 1, 2, 5, 30]), rng.random() < 0.5) for i in range(rng.randrange(6))]
        pieces, over = place_sections(iter(sections), chain, o)
        want, want_over = model(sections, chain, o)
        assert expand(pieces, o) == want and over == want_over
        ran_out += over
        if over:
            assert sum(k == "record" for _, _, k, _, _ in want) <= sum(s[3] for s in sections)
    assert ran_out > 300


def test_continued_header(spark):
    chain = [Frame("a", "1", 60.0), Frame("b", "1", 60.0)]
    rows = spark.createDataFrame([("doc", 0, True, 0, 3, False)], "unit string, section_ord long, header boolean, level int, n long, footer boolean")
    got = sorted((r.frame, r.y_pt, r.kind, r.rec_from, r.rec_to, r.continued) for r in paginate(rows, "unit", chain).collect())
    assert got == [("a", 0.0, "header", 0, 0, False), ("a", 16.0, "records", 0, 2, False), ("b", 0.0, "header", 0, 0, True), ("b", 16.0, "records", 2, 3, False)]


def test_batch_places_every_record_once(spark):
    df = spark.createDataFrame([(f"u{i % 3}", f"k{i % 7}", i) for i in range(200)], "unit string, k string, i long")
    placed, pieces, rows = run_batch(df, "unit", ["k"], [Frame(f"f{i}", "p", 90.0) for i in range(40)])
    got = placed.collect()
    assert sorted(r.i for r in got) == list(range(200)) and len({(r.unit, r.frame, r.y_pt) for r in got}) == 200
    assert {(r.placed == r.total, r.overflow) for r in flow_summary(pieces, rows, "unit").collect()} == {(True, False)}


def test_nested_sections_and_modes(spark):
    df = spark.createDataFrame([("doc", "a", "x", 1), ("doc", "a", "x", 2), ("doc", "a", "y", 3), ("doc", None, "y", 4)], "unit string, k string, j string, i long")
    chain = [Frame(f"f{i}", "p", 80.0) for i in range(9)]
    _, _, rows = run_batch(df, "unit", ["k", "j"], chain, footer=True)
    assert sorted((r.section_ord, r.level, r.n, r.footer) for r in rows.collect()) == [(0, 0, 0, False), (1, 1, 1, True), (2, 0, 0, False), (3, 1, 2, True), (5, 1, 1, True)]
    placed, pieces, _ = run_batch(df, "unit", ["k", "j"], chain, footer=True)
    # 16 + 16 + 20 + 20 fills the first frame to 72; the next two headers need a second one, and so on.
    assert sorted((r.frame, r.y_pt, r.i) for r in placed.collect()) == [("f0", 32.0, 4), ("f1", 32.0, 1), ("f1", 52.0, 2), ("f2", 36.0, 3)]
    assert {(r.frame, r.y_pt) for r in pieces.where("kind = 'footer'").collect()} == {("f0", 52.0), ("f2", 0.0), ("f2", 56.0)}
    _, pieces, rows = run_batch(df, "unit", ["k", "j"], chain, mode="group", footer=True)
    assert sorted((r.section_ord, r.placed, r.total, r.frames) for r in flow_summary(pieces, rows, ["unit", "section_ord"]).collect()) == [(0, 0, 0, 1), (1, 1, 1, 1), (2, 0, 0, 1), (3, 2, 2, 1), (5, 1, 1, 1)]
    placed, pieces, rows = run_batch(df, "unit", ["k", "j"], chain, mode="record", footer=True)
    assert sorted((r.i, r.frame, r.y_pt) for r in placed.collect()) == [(i, "f0", 16.0) for i in (1, 2, 3, 4)]
    assert pieces.count() == 8 and {(r.placed, r.total, r.overflow) for r in flow_summary(pieces, rows, ["unit", "section_ord", "rec_no"]).collect()} == {(1, 1, False)}
    placed, pieces, rows = run_batch(df, "unit", ["k"], [], mode="record")
    assert placed.count() == 0 and {(r.placed, r.overflow) for r in flow_summary(pieces, rows, ["unit", "section_ord", "rec_no"]).collect()} == {(0, True)}
    placed, _, rows = run_batch(df, "unit", [], chain)
    assert placed.count() == 4 and [(r.header, r.n) for r in rows.collect()] == [(False, 4)]
    assert run_batch(df.limit(0), "unit", ["k", "j"], chain)[0].count() == 0


def test_a_frame_holds_one_run_of_a_section():
    pieces, _ = place_sections(iter([(0, True, 0, 50, False)]), Pages(100.0).frames([(0, True, 0, 50, False)], FlowOptions()), FlowOptions())
    runs = [p[5] for p in pieces if p[1] == "records"]
    assert runs == sorted(set(runs))


def test_catalog_of_any_length_is_whole(spark, tmp_path):
    """One type with more records than 200 frames hold, in sections of many frames."""
    rows = spark.range(9000).selectExpr("'t' AS p_type", "concat('b', id % 2) AS p_brand", "'n' AS p_name", "id AS p_partkey")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["paginate_catalog"](spark, str(tmp_path)).collect()
    assert len({r.p_partkey for r in got}) == len(got) == 9000 and len({(r.frame, r.y_pt) for r in got}) == 9000
    assert [(r.placed, r.total, r.overflow) for r in QUERIES["paginate_summary"](spark, str(tmp_path)).collect()] == [(9000, 9000, False)]


def test_pages_are_enough():
    rng = random.Random(8)
    for _ in range(3000):
        o = FlowOptions(rng.choice([1.1, 7.3, 20.0, 70.0]), rng.choice([0.1, 5.0, 16.0]), rng.choice([3.0, 20.0]), rng.random() < 0.8, rng.random() < 0.5)
        sections = [(i, rng.random() < 0.8, rng.randrange(3), rng.choice([0, 1, 2, 5, 30, 500]), rng.random() < 0.5) for i in range(rng.randrange(6))]
        pages = Pages(rng.choice([20.0, 33.3, 60.0, 100.1, 400.0]))
        pieces, over = place_sections(iter(sections), pages.frames(sections, o), o)
        assert not over and sum(p[4] - p[3] for p in pieces if p[1] == "records") == sum(s[3] for s in sections)


def test_widths(spark):
    df = spark.createDataFrame([("abc", 1), ("", 12345)], "a string, b long")
    assert [(r.name, r.width_pt, r.x_pt) for r in column_widths(df, {"a": "A", "b": "B"}).orderBy("ord").collect()] == [("a", 26.0, 0.0), ("b", 38.0, 26.0)]


def test_table_layout(spark):
    """Rows, rules and box of a small table against a plain walk; tables without rows or header."""
    rows = [(2, "bb", None), (1, "a", "long cell"), (2, "bb", None)]
    df = spark.createDataFrame(rows, "k int, name string, note string")
    for frame, header in ((df, True), (df, False), (df.where("k > 9"), True), (df.where("k > 9"), False)):
        o = layout.TableOptions(row_pt=10.0, char_pt=5.0, pad_pt=1.0, header=header)
        table = layout.table_layout(frame, {"k": "Key", "note": "Note"}, ["k"], o)
        kept = sorted(rows, key=lambda r: r[0]) if frame is df else []
        lines = ["Key\tNote"] * header + [f"{k}\t{note or ''}" for k, _, note in kept]
        widths = [17.0, 5.0 * max([4, *(len(n or "") for _, _, n in kept)]) + 2]
        assert [(r.row_no, r.header, r.y_pt, r.height_pt, r.text) for r in table.rows.orderBy("row_no").collect()] == [(i, header and i == 0, 10.0 * i, 10.0, t) for i, t in enumerate(lines)]
        assert tuple(table.box.first()) == (2, len(lines), sum(widths), 10.0 * len(lines))
        want = [("row", 0.0, 10.0 * i, sum(widths), 10.0 * i) for i in range(len(lines) + 1)] + [("column", x, 0.0, x, 10.0 * len(lines)) for x in (0.0, widths[0], sum(widths))]
        assert sorted(tuple(r) for r in table.rules.collect()) == sorted(want)
