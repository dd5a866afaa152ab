"""Shaping, binding, synchronisation, governance and sources on small fixtures."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.functions.fx import field
from quire.operators import bind, codes, govern, shape, sync
from quire.plans import batch
from quire.queries import QUERIES
from quire.sources import files
from quire.streaming.refresh import trigger_of


@pytest.fixture(scope="module")
def shop(spark):
    return spark.createDataFrame([("A", "x", 1.0), ("B", "y", 2.0), ("A", "z", 3.0)], "cat string, name string, price double")


def test_stable_index_is_independent_of_delivery(spark):
    rows = [(i % 5, i % 3, None if i % 7 == 0 else i % 4) for i in range(500)]
    want = sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))
    for seed in (1, 2):
        df = spark.createDataFrame(rows, "a long, b long, c long").orderBy(F.rand(seed)).repartition(seed + 2)
        got = [(r.a, r.b, r.c) for r in sorted(shape.stable_index(df, ["a"]).collect(), key=lambda r: r.row_idx)]
        assert got == want
    with pytest.raises(ValueError):
        shape.stable_index(df, ["nope"])


def test_content_hash(spark, shop):
    one = shape.content_hash(shop).first()
    assert shape.content_hash(shop.orderBy(F.desc("price"))).first() == one
    assert shape.content_hash(shop.union(shop)).first() != one and shape.content_hash(shop.where("price > 1")).first() != one
    a, b = (spark.createDataFrame([r], "a string, b string") for r in (("x", None), (None, "x")))
    assert shape.content_hash(a).first() != shape.content_hash(b).first()


def test_shapes(shop):
    assert shape.single_record(shop, ["price"]).first().name == "x" and shape.nth_record(shop, ["price"], 9).count() == 0
    assert shape.scalar(shop, ["price"], "name").first().value == "x" and shape.scalar(shop.where("false"), ["price"]).first().value is None
    assert shape.param_hash({"a": 1, "b": "1"}) == shape.param_hash({"b": "1", "a": 1}) != shape.param_hash({"a": "1", "b": "1"})


def test_sections(shop):
    got = {r.cat: (r.n, r.footer) for r in bind.sections(shop, ["cat"], "Subtotal ({count})", "price").collect()}
    assert got == {"A": (2, ["Subtotal (2)", "4.00"]), "B": (1, ["Subtotal (1)", "2.00"])}
    stream = bind.section_stream(shop, ["cat"], [("", field(shop, "name"))], "end").orderBy("section_ord", "kind", "row_idx").collect()
    assert [r.cells[0] for r in stream] == ["A", "x", "z", "end", "B", "y", "end"]


def test_header_levels_agree_with_a_walk(spark):
    rows = sorted({(i * 7 % 3, i * 5 % 4, i * 3 % 5) for i in range(40)})
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = [(r.section_ord, r.level, r.text, r.leaf) for r in bind.section_headers(bind.sections(df, ["a", "b", "c"]), ["a", "b", "c"]).orderBy("section_ord", "level").collect()]
    want, last = [], None
    for ord_, row in enumerate(rows):
        first = next((i for i in range(3) if last is None or row[: i + 1] != last[: i + 1]), 2)
        want += [(ord_, lv, str(row[lv]), lv == 2) for lv in range(first, 3)]
        last = row
    assert got == want


def test_rules_and_images(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 10.0), ("c", 0.0)], "sku string, stock double")
    from quire.functions.fx import compare

    low = {"low": compare("<", field(df, "stock"), 5)}
    assert sorted((r.row_idx, r.table_row) for r in bind.rules(df, ["sku"], low).collect()) == [(0, 1), (2, 3)]
    assert bind.rule_totals(df, low).first() == ("low", 2, 3)
    refs = spark.createDataFrame([("https://x/a.png",), ("asset:9",), ("",), (None,), ("img/c.jpg",)], "r string").select(bind.image_reference(F.col("r")).alias("i"))
    assert [tuple(r.i) for r in refs.collect()] == [("uri", "https://x/a.png", "ok"), ("asset", "9", "ok"), ("missing", None, "flagged"), ("missing", None, "flagged"), ("path", "img/c.jpg", "ok")]


def test_row_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "id string, qty long")
    new = spark.createDataFrame([("a", 1), ("b", 9), ("d", 4), (None, 4)], "id string, qty long")
    assert {(r.id, r.change_type) for r in sync.row_diff(old, new, ["id"]).collect()} == {("a", "unchanged"), ("b", "updated"), ("d", "inserted"), ("c", "removed"), (None, "unchanged")}
    assert {r.change_type for r in sync.row_diff(old, old, ["id"]).collect()} == {"unchanged"}
    assert {(r.change_type, r.n) for r in sync.diff_summary(sync.row_diff(old.union(old), new, [])).collect()} == {("unchanged", 2), ("inserted", 2), ("removed", 2)}


def test_sync_states(spark):
    state = spark.createDataFrame([(1, "q", "linked"), (2, "q", "pinned"), (3, "r", "linked"), (4, "q", "linked")], "binding_id long, query_id string, status string")
    changed = spark.createDataFrame([("q",)], "query_id string")
    actions = spark.createDataFrame([(4, "resolve"), (3, "override")], "binding_id long, action string")
    after = sync.transition(state, changed, actions)
    assert {r.binding_id: r.status for r in after.collect()} == {1: "stale", 2: "pinned", 3: "overridden", 4: "linked"}
    assert [r.binding_id for r in sync.sync_report(after).collect()] == [1, 2, 3]
    before, now = (spark.createDataFrame(x, "binding_id string, fingerprint string") for x in ([("a", "1"), ("b", "2")], [("a", "1"), ("c", "3")]))
    assert {tuple(r) for r in sync.change_report(before, now).collect()} == {("a", "unchanged"), ("b", "removed"), ("c", "added")}


def test_governance(spark, shop):
    live = spark.createDataFrame([("a", 1.5, "s")], "sku string, price double, secret string")
    side = spark.createDataFrame([("t", "sku", "SKU", None, "text", "x"), ("t", "price", None, None, "int", None), ("t", "discount", None, None, "float", None)], "table_name string, name string, label string, description string, data_type string, provenance string")
    catalog = govern.column_catalog(spark, {"t": live})
    assert {(r.name, r.diagnostic) for r in govern.drift(catalog, side).collect()} == {("price", "typeMismatch"), ("secret", "undocumentedColumn"), ("discount", "missingColumn")}
    assert {r.name: (r.label, r.data_type, r.documented) for r in govern.governed_columns(catalog, side).collect()} == {"sku": ("SKU", "text", True), "price": ("price", "float", True), "secret": ("secret", "text", False)}
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rev, wrote = govern.publish(shop, root, "shop", "demo")
    assert wrote and govern.publish(shop.orderBy("price"), root, "shop", "demo") == (rev, False)
    assert govern.publish(shop.where("price > 1"), root, "shop", "demo")[0] != rev
    assert spark.read.parquet(f"{root}/shop/rev={rev}").count() == 3


def test_suggestions(spark):
    names = ["unit_price", "SKU", "1st", "TRUE", "naïve-col", "__", "true"]
    df = spark.createDataFrame([("t", n, "text") for n in names], "table_name string, name string, data_type string")
    got = {r.name: (r.header, r.expr, r.mappable) for r in bind.suggestions(df).collect()}
    assert got["unit_price"] == ("Unit Price", "unit_price", True) and got["SKU"][0] == "SKU" and got["1st"] == ("1st", "", False) and got["TRUE"][2] is False
    assert got["naïve-col"] == ("Naïve Col", "", False) and got["__"][0] == "__" and got["true"][2] is True
    fits = spark.createDataFrame([("fit",), ("crop",), ("x",)], "m string").select(bind.fitting(F.col("m")).alias("f"))
    assert [r.f for r in fits.collect()] == ["Proportionally", "FitContentToFrame", None]


def test_codes(spark):
    df = spark.createDataFrame([("400638133393",), ("4006381333931",), ("4006381333930",), ("40063813339x",), ("123",), ("",), (None,)], "c string")
    assert [r.a.reason for r in df.select(codes.gtin_audit(F.col("c")).alias("a")).collect()] == ["ok", "ok", "checkDigit", "nonDigit", "wrongLength", "empty", "empty"]
    upc = spark.createDataFrame([("03600029145",)], "c string").select(codes.gtin_audit(F.col("c"), "upca").alias("a")).first().a
    assert upc.canonical == "036000291452"
    sizes = spark.createDataFrame([(n, "x" * n) for n in (0, 14, 15, 180, 213, 214)], "n long, t string")
    assert [r.v for r in sizes.select(codes.qr_version(F.col("t")).alias("v")).collect()] == [None, 1, 2, 9, 10, None]
    assert [r.v for r in spark.createDataFrame([("ok~",), ("é",), ("",)], "t string").select(codes.code128_audit(F.col("t")).alias("v")).collect()] == ["ok", "notEncodable", "empty"]


def test_batch_plans(spark):
    df = spark.createDataFrame([("s1", "west", 1.0), ("s2", "east", 2.0), ("s3", "east", 3.0)], "store string, region string, qty double")
    assert [(r.store, r.unit, r.unit_label) for r in batch.plan_per_group(df, ["region"]).orderBy("store").collect()] == [("s1", 1, "west"), ("s2", 0, "east"), ("s3", 0, "east")]
    assert [r.unit_label for r in batch.plan_per_record(df, ["store"]).orderBy("unit").collect()] == ["row-0", "row-1", "row-2"]
    assert {r.unit_label for r in batch.plan_catalog(df).collect()} == {"catalog"}


def test_sources(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame([("A-1", 9.99), ("B-2", 19.99)], "sku string, price double")
    files.write_text_table(df, f"{root}/tsv")
    assert sorted(map(tuple, files.read_file(spark, f"{root}/tsv", "tsv").collect())) == [("A-1", 9.99), ("B-2", 19.99)]
    now = files.landed_fingerprints(spark, f"{root}/tsv", "https://x", "tsv", {"a": "1"})
    last = now.cache()
    assert now.count() >= 1 and files.changed_files(now, last).count() == 0
    assert files.changed_files(files.landed_fingerprints(spark, f"{root}/tsv", "https://x", "tsv", {"a": "2"}), last).count() == now.count()
    urls = spark.createDataFrame([("https://a.com/x",), ("http://b:8080",), ("ftp://c",), ("d.com",), ("https:///x",), ("https://u:p@e.com/",), (None,)], "u string")
    assert [r.r for r in urls.select(files.url_reason(F.col("u")).alias("r")).collect()] == ["ok", "ok", "badScheme", "noScheme", "emptyHost", "embeddedCredentials", "empty"]
    assert [r.o for r in urls.select(files.origin_of(F.col("u")).alias("o")).collect()] == ["https://a.com", "http://b:8080", "ftp://c", None, None, "https://e.com", None]
    listed = [(1, "dbAttach", "postgres://u:p@h/db", "postgres"), (2, "file", "s3://b/x.csv", None), (3, "dbAttach", "x.db", "sqlite"), (4, "remote", "https://u:p@a.com/x?y", None), (5, "governedExtract", "https://a.com/x", None), (6, "inline", "seed", None)]
    got = files.inventory(spark.createDataFrame(listed, "id long, kind string, target string, db string")).orderBy("id").collect()
    assert [(r.capability, r.target) for r in got] == [("networkCredential", "postgres://h/db"), ("fileImport", "s3://b/x.csv"), ("fileImport", "x.db"), ("network", "https://a.com"), ("network", "https://a.com/x"), ("none", "inline:seed")]
    files.write_documents(df.withColumn("unit", F.col("sku")), "unit", f"{root}/docs")
    assert spark.read.json(f"{root}/docs").count() == 2
    assert trigger_of("interval", 30) == {"processingTime": "30 seconds"} and trigger_of("onOpen") == {"availableNow": True}


def test_database(spark, monkeypatch):
    url = f"jdbc:derby:memory:quire{os.getpid()};create=true"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id long, name string")
    df.write.format("jdbc").option("url", url).option("dbtable", "t").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    monkeypatch.setenv("DB_USER", "app"), monkeypatch.setenv("DB_PASSWORD", "app")
    got = files.read_database(spark, url, "t", "DB", partitionColumn="id", lowerBound=0, upperBound=20, numPartitions=2, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.count() == 20 and got.rdd.getNumPartitions() == 2


def test_plans(spark):
    """No record-sized frame goes through one partition, and expressions need no Python."""
    from quire.queries import QUERIES

    for name in ("brand_sections", "formatted_price_list", "text_kernels", "row_diff", "stable_row_index", "rule_totals"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_event_refresh_lands_in_parallel(spark, tmp_path):
    """Snapshots of several partitions land as several files, which one batch reads together."""
    spark.range(0, 1000, 1, 4).selectExpr("id AS event_id", "id AS user_id", "'t' AS event_type", "double(id) AS value").write.parquet(f"{tmp_path}/events.parquet")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    old = set(glob.glob(f"{root}/quire-refresh-*"))
    got = {(r.batch, r.change_type): r.n for r in QUERIES["event_refresh"](spark, str(tmp_path)).collect()}
    (new,) = set(glob.glob(f"{root}/quire-refresh-*")) - old
    assert len(glob.glob(f"{new}/landed/rows/*/*.parquet")) > 2
    assert {n for (_, kind), n in got.items() if kind == "removed"} == {50} and len({batch for batch, _ in got}) == 2, got


def test_parameters_by_kind(spark):
    decls = [shape.ParamDecl("b", "bool"), shape.ParamDecl("n", "number"), shape.ParamDecl("m", "number")]
    row = shape.parameterised(spark, "SELECT :b AS b, :n AS n, :m AS m", decls, {"b": "false", "n": 2**53 + 1, "m": "1.5"}).first()
    assert (row.b, row.n, row.m) == (False, 2**53 + 1, 1.5)
    with pytest.raises(ValueError):
        shape.parameterised(spark, "SELECT :b", decls, {"b": "perhaps"})


def test_whole_row_diff(spark):
    old = spark.createDataFrame([(1, None), (1, None), (2, "a"), (3, "b")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, "x"), (2, "x"), (3, "b"), (3, "b")], "k int, v string")
    got = sorted((r.k, r.v or "", r.change_type) for r in sync.row_diff(old, new, []).collect())
    assert got == [(1, "", "unchanged"), (2, "a", "removed"), (2, "x", "inserted"), (2, "x", "inserted"), (3, "b", "unchanged"), (3, "b", "unchanged")]
