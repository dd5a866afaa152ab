"""The registered queries of the library's own operators: each takes ``(spark, sf_dir)`` and reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import formats, logic, maths, temporal, text
from quire.functions.fx import add, compare, concat, display, div, equal, field, mul, param, unpacked
from quire.functions.sql import register
from quire.operators import bind, codes, govern, ordered, revisions, shape, sync
from quire.plans import batch, flow, layout
from quire.sources import blocks, files, packed
from quire.streaming.refresh import land_marker, land_rows, refresh
from quire.streaming.state import BindingState

RUN_DATE = date(2026, 6, 8)
CHAIN = layout.Pages(400.0)
#: Keys of an exported file, and bytes of a block of its hash tree.
EXPORT_KEYS = 8192
EXPORT_BLOCK = 4096
ALLOWED = ("https://therin.example.net", "http://therha.example.com", "https://m.thther.example.org")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.read_file(spark, f"{sf_dir}/{name}.parquet", "parquet")


def sidecar(spark: SparkSession) -> DataFrame:
    """Documentation of six tables, with gaps and errors on purpose."""
    rows = [
        ("part", "p_partkey", "Part", "Key of the part", "int", "erp"), ("part", "p_name", "Name", None, "text", "erp"), ("part", "p_retailprice", "Price", "List price", "int", "erp"), ("part", "p_colour", "Colour", None, "text", "erp"),
        ("orders", "o_orderkey", "Order", None, "int", "shop"), ("orders", "o_orderdate", None, "Day of order", "datetime", "shop"), ("customer", "c_acctbal", "Balance", None, "text", "crm"),
        ("events", "ts", "Time", "When it happened", "date", "app"), ("documents", "text", "Text", None, "text", "crawl"), ("embeddings", "embedding", "Vector", None, "float", "model"),
    ]
    return spark.createDataFrame(rows, "table_name string, name string, label string, description string, data_type string, provenance string")


@query
def brand_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    sold = lines.join(part, lines.l_partkey == part.p_partkey).select("p_brand", "l_extendedprice")
    s = bind.sections(sold, ["p_brand"], "{count} items", "l_extendedprice")
    return s.select("p_brand", "n", "section_ord", F.col("footer")[0].alias("label"), F.col("footer")[1].alias("total"))


@query
def section_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    parts = [bind.sections(part, ["p_brand", "p_type"], "{count}", "p_size", how).select("p_brand", "p_type", "n", F.lit(how).alias("agg"), F.col("footer")[1].alias("total")) for how in ("avg", "min", "max")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def nested_section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["p_brand", "p_type"]
    return bind.section_headers(bind.sections(load(spark, sf_dir, "part"), keys), keys)


@query
def section_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    template = [("", field(part, "p_name")), ("Price ", formats.currency(field(part, "p_retailprice")))]
    s = bind.section_stream(part, ["p_brand"], template, "{count} items", "p_retailprice")
    return s.select("section_ord", "kind", "level", "row_idx", F.array_join("cells", "|").alias("cells"))


@query
def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by date as one text in several files: its lines, bytes and headers."""
    path = f"{shape.shared_folder(spark)}/quire-text-{uuid.uuid4().hex}"
    o = load(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_orderstatus")
    files.write_ordered_text(o, ["o_orderdate", "o_orderkey"], path, ["o_orderkey", "o_orderstatus"], partitions=8)
    size = spark.read.json(f"{path}/manifest").agg(F.max(F.col("offset") + F.col("n_bytes")).alias("n_bytes"), F.min("part").alias("__first"))
    lines = files.read_text_lines(spark, path).agg(F.count("*").alias("n_lines"), F.count(F.when(F.col("line").startswith("o_"), 1)).alias("n_headers"), F.min(F.when(F.col("line").startswith("o_"), F.col("part"))).alias("__at"))
    return lines.crossJoin(size).select("n_lines", "n_bytes", "n_headers", (F.col("__at") == F.col("__first")).alias("header_first"))  # a row each


@query
def packed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed as a document for each order, and read back: rows, quantity, the line numbers in order, pieces."""
    path = f"{shape.shared_folder(spark)}/quire-packed-{uuid.uuid4().hex}"
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    packed.pack_documents(lines, "l_orderkey", ["l_linenumber"], path)
    back = packed.read_packed(spark, path, lines.schema)
    placed = F.array_sort(F.collect_list(F.struct("__part", "__pos", "l_linenumber")))
    return back.groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").cast("double").alias("quantity"), F.array_join(F.transform(placed, lambda x: x["l_linenumber"].cast("string")), ",").alias("line_numbers"))


@query
def landed_tree_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one text for each ``EXPORT_KEYS`` keys, and the hash tree of each of these files, from ranges of four blocks."""
    path = f"{shape.shared_folder(spark)}/quire-exports-{uuid.uuid4().hex}"
    o = load(spark, sf_dir, "orders")
    lines = o.select(F.floor(F.col("o_orderkey") / EXPORT_KEYS).cast("long").alias("export"), "o_orderkey", F.concat_ws("\t", "o_orderkey", "o_custkey", "o_orderstatus").alias("value"))
    lines = lines.repartition("export").sortWithinPartitions("export", "o_orderkey", "value").select("export", "value")
    lines.write.partitionBy("export").text(path)
    trees = blocks.tree_hashes(spark, path, block=EXPORT_BLOCK, fanout=4, levels=1, split=4 * EXPORT_BLOCK)
    return trees.select(F.regexp_extract("path", r"export=(\d+)", 1).cast("long").alias("export"), "n_bytes", "n_blocks", "root")


@query
def formatted_price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    price, size = field(part, "p_retailprice"), field(part, "p_size")
    columns = {"name": field(part, "p_name"), "price": formats.currency(price), "price_de": formats.currency(price, locale="de"), "rounded": formats.number(price), "share": formats.percent(div(size, 50), 1)}
    return bind.formatted_table(part, ["p_brand"], columns)


@query
def text_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "customer")
    name, seg = field(df, "c_name"), field(df, "c_mktsegment")
    cells = {
        "up": text.upper(name), "low": text.lower(seg), "n": text.len_(name), "first": text.left(seg, 3), "last": text.right(name, 4), "middle": text.mid(name, 2, 5), "proper": text.proper(seg),
        "sub": text.substitute(name, "0", "o"), "at": text.find("u", name), "lost": text.find("@", name), "joined": text.textjoin(" - ", seg, "", name), "twice": text.rept(seg, 2), "trimmed": text.trim(concat("  ", seg, "\t")), "both": concat(name, "/", seg),
    }
    return df.select("c_custkey", *(display(x).alias(k) for k, x in cells.items()))


@query
def math_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "orders")
    total, key, cust = field(df, "o_totalprice"), field(df, "o_orderkey"), field(df, "o_custkey")
    cells = {
        "abs": maths.abs_(add(total, -1000.0)), "rounded": maths.round_(total), "floor": maths.floor(total), "ceil": maths.ceiling(total), "trunc": maths.trunc(total), "mod": maths.mod(mul(key, -1), 7), "mod0": maths.mod(key, 0), "pow": maths.power(maths.mod(key, 10), 3),
        "sign": maths.sign(add(cust, -100)), "least": maths.min_(key, cust, None), "most": maths.max_(key, cust, None), "sum": maths.sum_(key, None, cust),
    }
    return df.select("o_orderkey", *(display(x).alias(k) for k, x in cells.items()))


@query
def logic_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "customer")
    bal, seg, nation = field(df, "c_acctbal"), field(df, "c_mktsegment"), field(df, "c_nationkey")
    low = compare("<", bal, 0)
    cells = {
        "state": logic.if_(low, "debt", "credit"), "both": logic.and_(low, compare(">", nation, 10)), "either": logic.or_(low, compare(">", nation, 10)), "neither": logic.not_(low), "blank": logic.isblank(seg), "bad": logic.iserror(div(1, nation)),
        "first": logic.coalesce(None, seg), "region": logic.switch(nation, 0, "zero", "1", "one", "other"), "safe": logic.iferror(div(100, nation), -1), "same": equal(nation, "5"),
    }
    return df.select("c_custkey", *(display(x).alias(k) for k, x in cells.items()))


@query
def date_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "orders")
    d = field(df, "o_orderdate")
    cells = {"y": temporal.year(d), "m": temporal.month(d), "d": temporal.day(d), "wd": temporal.weekday(d), "shown": formats.datefmt(d), "de": formats.datefmt(d, locale="de"), "own": formats.datefmt(d, "DD/MM/YY"), "run": temporal.today(RUN_DATE)}
    return df.select("o_orderkey", *(display(x).alias(k) for k, x in cells.items()))


@query
def sql_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe as SQL text, with the functions registered for the session."""
    register(spark)
    cells = {
        "price": "fx_currency(p_retailprice)", "share": "fx_percent(p_size / 50D, 1)", "rounded": "CAST(fx_round(p_retailprice) AS BIGINT)", "cut": "CAST(fx_trunc(-p_retailprice) AS BIGINT)", "rest": "CAST(fx_mod(-p_partkey, 7) AS BIGINT)",
        "none": "fx_mod(p_partkey, 0)", "kind": "fx_proper(p_type)", "at": "fx_find('#', p_brand)", "part": "fx_mid(p_name, 2, 4)", "end": "fx_right(p_name, 3)", "blank": "fx_isblank(nullif(p_type, p_type))",
    }
    return load(spark, sf_dir, "part").selectExpr("p_partkey", *(f"{e} AS {n}" for n, e in cells.items()))


@query
def catalog_join_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("lineitem", "part", "supplier", "nation"):
        load(spark, sf_dir, t).createOrReplaceTempView(t)
    sql = """
        SELECT p.p_brand, n.n_name, count(*) AS n_lines, CAST(round(sum(l.l_quantity)) AS BIGINT) AS qty
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
        WHERE p.p_size >= :least AND l.l_shipdate >= :since GROUP BY p.p_brand, n.n_name"""
    decls = [shape.ParamDecl("least", "number", True), shape.ParamDecl("since", "date", True)]
    return shape.parameterised(spark, sql, decls, {"least": 10, "since": "1995-01-01"})


@query
def single_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.single_record(load(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query
def nth_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.nth_record(load(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], 41).select("o_orderkey", "o_custkey", "o_orderstatus")


@query
def scalar_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_status = load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return shape.scalar(by_status, ["o_orderstatus"], "n")


@query
def stable_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.stable_index(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query
def appended_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers after two appends, of which each reads the ranges that it adds to."""
    folder = f"{shape.shared_folder(spark)}/quire-ordered-{uuid.uuid4().hex}"
    lines, keys = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"]
    ordered.create(lines.where("l_orderkey % 2000 >= 100"), keys, folder, rows_per_range=20_000)
    for part in (0, 1):
        ordered.append(lines.where(f"l_orderkey % 2000 < 100 AND l_orderkey % 2 = {part}"), keys, folder, rows_per_range=20_000)
    return ordered.read(spark, folder)


@query
def grouped_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape.stable_index(load(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_orderpriority"), ["o_orderdate", "o_orderkey"])
    return shape.grouped(rows, ["o_orderpriority"])


@query
def content_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision of a table, of its rows in another order, and of a table in which some rows differ."""
    df = load(spark, sf_dir, "lineitem")
    changed = df.withColumn("l_quantity", F.when(F.col("l_orderkey") % 1000 == 1, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    h = {name: shape.content_hash(x).select(F.col("n_rows").alias(f"n_{name}"), F.struct("h1", "h2").alias(name), F.col("schema_hash").alias(f"s_{name}")) for name, x in (("own", df), ("moved", df.hint("rebalance", "l_suppkey")), ("changed", changed))}
    one = h["own"].crossJoin(h["moved"]).crossJoin(h["changed"])  # a row each
    return one.select(F.col("n_own").alias("n_rows"), F.col("s_own").alias("schema_hash"), (F.col("own") == F.col("moved")).alias("same_in_other_order"), (F.col("own") == F.col("changed")).alias("same_after_change"))


@query
def rule_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    quantity = field(df, "l_quantity")
    return bind.rules(df, ["l_orderkey"], {"small": compare("<", quantity, 5), "dear": compare(">", field(df, "l_extendedprice"), 50000), "broken": compare("<", div(quantity, 0), 1)})


@query
def rule_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a catalogue's table with the style that a rule gives them."""
    df = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    fired = bind.rules(df, ["p_partkey"], {"small": compare("<", field(df, "p_size"), 5), "dear": compare(">", field(df, "p_retailprice"), 1500), "plain": compare(">", field(df, "p_size"), 45)}, header_rows=2)
    return bind.styled_cells(fired, {"small": (2, "Compact"), "dear": (3, "Warning")})


@query
def rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "lineitem")
    qty = field(df, "l_quantity")
    return bind.rule_totals(df, {"few": compare("<", qty, 5), "many": compare(">=", qty, 45), "returned": equal(field(df, "l_returnflag"), "R")})


@query
def image_reference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    ref = F.when(F.col("page_id") % 7 == 0, None).when(F.col("page_id") % 7 == 1, "").when(F.col("page_id") % 7 == 2, F.concat(F.lit("asset:"), F.col("page_id").cast("string"))).when(F.col("page_id") % 7 == 3, F.lit("img/a.png")).otherwise(F.col("url"))
    seen = pages.select(bind.image_reference(ref, "fallback", "asset:none").alias("i"))
    return seen.groupBy("i.kind", "i.status").agg(F.count("*").alias("n"), F.count(bind.placeable(F.col("i"))).alias("placeable"), F.countDistinct("i.ref").alias("refs"))


@query
def inline_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under the words of a lookup table that comes with the recipe; codes that it has not are kept without."""
    words = files.seed(spark, [("A", "accepted"), ("R", "returned")], "flag string, word string")
    lines = load(spark, sf_dir, "lineitem")
    return lines.join(words, lines.l_returnflag == words.flag, "left").groupBy("l_returnflag", "word").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query
def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters in expressions: one that is bound, and one that is not and so is null."""
    p, given = load(spark, sf_dir, "part"), {"rate": 1.5, "note": "net"}
    price = mul(field(p, "p_size"), param(given, "rate"))
    return p.select("p_partkey", price.value.alias("price"), display(concat(param(given, "note"), " ", field(p, "p_size"), param(given, "absent"))).alias("shown"), equal(param(given, "absent"), None).value.alias("absent"))


@query
def mixed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one JSON column that are numbers, numeric texts, booleans, nulls, texts and objects, in expressions with another."""
    m, value = F.col("event_id") % 6, F.col("value").cast("string")
    cell = (
        F.when(m == 0, value).when(m == 1, F.concat(F.lit('"'), value, F.lit('"'))).when(m == 2, (F.col("event_id") % 12 == 2).cast("string"))
        .when(m == 3, "null").when(m == 4, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(F.col("props"))
    )
    e = load(spark, sf_dir, "events").select("event_id", F.try_parse_json(cell).alias("a"), F.try_variant_get(F.try_parse_json("props"), "$.k", "variant").alias("b"))
    e = unpacked(e, "a", "b")
    a, b = field(e, "a"), field(e, "b")
    total = add(a, b)
    return e.select("event_id", display(a).alias("shown"), total.value.alias("total"), total.err.alias("total_error"), equal(a, b).value.alias("same"), compare("<", a, b).value.alias("less"), logic.isblank(a).value.alias("blank"))


@query
def origin_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    consented = pages.where(F.col("page_id") % 5 == 0).select(files.origin_of(F.col("url")).alias("origin"))
    return files.authorised(pages, "url", consented).select("page_id", "origin", "allowed", "reason")


@query
def url_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    k = F.col("page_id") % 6
    url = F.when(k == 0, F.regexp_replace("url", "^https?", "ftp")).when(k == 1, F.regexp_replace("url", "^https?://", "")).when(k == 2, F.regexp_replace("url", "://", "://user:secret@")).when(k == 3, F.regexp_replace("url", "://[^/]+", "://")).otherwise(F.col("url"))
    return pages.select(files.url_reason(url).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _orders_before_and_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    old = o.where("o_orderkey % 50 <> 1")
    new = o.where("o_orderkey % 50 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 50 == 3, "X").otherwise(F.col("o_orderstatus")))
    return old, new


@query
def row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.row_diff(*_orders_before_and_after(spark, sf_dir), ["o_orderkey"])


@query
def row_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.diff_summary(sync.row_diff(*_orders_before_and_after(spark, sf_dir), ["o_orderkey"]))


def _revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and orders of which every fifth range of 1000 keys has changed in places."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    touched = F.floor(F.col("o_orderkey") / 1000) % 5 == 0
    new = o.where(~touched | (F.col("o_orderkey") % 50 != 2)).withColumn("o_orderstatus", F.when(touched & (F.col("o_orderkey") % 50 == 3), "X").otherwise(F.col("o_orderstatus")))
    return o.where(~touched | (F.col("o_orderkey") % 50 != 1)), new


@query
def merkle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two written revisions; ranges with like hashes are not read."""
    root = f"{shape.shared_folder(spark)}/quire-revisions-{uuid.uuid4().hex}"
    old, new = _revisions(spark, sf_dir)
    for name, df in (("old", old), ("new", new)):
        revisions.write_revision(df, f"{root}/{name}", revisions.range_leaf("o_orderkey", 1000))
    return revisions.merkle_diff(spark, f"{root}/old", f"{root}/new", "o_orderkey long, o_custkey long, o_orderstatus string", ["o_orderkey"])


@query
def incremental_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each range after a delta, and whether the hash carried forward by the delta is that of the rows themselves."""
    old, new = _revisions(spark, sf_dir)
    leaf = revisions.range_leaf("o_orderkey", 1000)
    delta = sync.row_diff(old, new, ["o_orderkey"]).where("change_type <> 'unchanged'").select("o_orderkey")
    after = revisions.carried(revisions.leaf_hashes(old, leaf), old.join(delta, "o_orderkey", "left_semi"), new.join(delta, "o_orderkey", "left_semi"), leaf)
    whole = revisions.leaf_hashes(new, leaf).select("leaf", F.struct("n", "s1", "s2").alias("__whole"))
    return after.join(whole, "leaf", "full_outer").select("leaf", "n", F.struct("n", "s1", "s2").eqNullSafe(F.col("__whole")).alias("same"))


@query
def row_diff_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return sync.diff_summary(sync.row_diff(x.where("l_orderkey % 40 <> 1"), x.where("l_orderkey % 40 <> 2"), []))


def _bindings(df: DataFrame, status: str) -> DataFrame:
    return df.select(F.concat(F.lit("cust-"), (F.col("o_custkey") % 97).cast("string")).alias("binding_id"), "o_orderkey", F.expr(status).alias("o_orderstatus"))


@query
def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    before = _bindings(o.where("o_custkey % 97 <> 5"), "o_orderstatus")
    after = _bindings(o.where("o_custkey % 97 <> 6"), "CASE WHEN o_custkey % 97 % 10 = 3 THEN 'X' ELSE o_orderstatus END")
    return sync.change_report(sync.keyed_fingerprints(before), sync.keyed_fingerprints(after))


@query
def sync_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    state = c.select(F.col("c_custkey").alias("binding_id"), F.col("c_nationkey").alias("query_id"), F.expr("CASE c_custkey % 5 WHEN 0 THEN 'pinned' WHEN 1 THEN 'overridden' ELSE 'linked' END").alias("status"))
    changed = load(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("query_id"))
    actions = c.where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("binding_id"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'pin' WHEN 1 THEN 'override' WHEN 2 THEN 'relink' ELSE 'resolve' END").alias("action"))
    return sync.transition(state, changed, actions)


@query
def sync_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings that a resolve links take the revision of their query's rows."""
    c = load(spark, sf_dir, "customer")
    state = c.select(F.col("c_custkey").alias("binding_id"), F.col("c_nationkey").alias("query_id"), F.expr("CASE c_custkey % 5 WHEN 0 THEN 'pinned' WHEN 1 THEN 'overridden' ELSE 'stale' END").alias("status"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 0L END").alias("last_resolved"))
    stamps = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("query_id")).agg(F.count("*").alias("stamp"))
    actions = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("binding_id"), F.lit("resolve").alias("action"))
    return sync.transition(state, stamps.where("query_id < 0"), actions, stamps)


@query
def resolve_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings that a second run resolves: those whose query's text or parameters changed since the first committed."""
    state = BindingState(spark, f"{shape.shared_folder(spark)}/quire-state-{uuid.uuid4().hex}")
    c = load(spark, sf_dir, "customer")

    def wanted(text: str, param: str) -> DataFrame:
        return c.select(F.col("c_custkey").cast("string").alias("binding_id"), F.sha2(F.expr(text), 256).alias("source_query_hash"), F.sha2(F.expr(param), 256).alias("param_hash"))

    state.resolve(wanted("concat('nation ', c_nationkey)", "c_mktsegment").where("CAST(binding_id AS BIGINT) % 10 <> 0"), lambda todo: None)
    done = state.resolve(wanted("concat('nation ', IF(c_nationkey % 5 = 1, -1, c_nationkey))", "IF(c_custkey % 7 = 0, 'all', c_mktsegment)"), lambda todo: None)
    return done.select(F.col("binding_id").cast("long").alias("binding_id"))


@query
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not linked after each nation's orders of one customer segment changed."""
    c = load(spark, sf_dir, "customer")
    state = c.select(F.col("c_custkey").alias("binding_id"), F.col("c_nationkey").alias("query_id"), F.expr("CASE c_custkey % 7 WHEN 0 THEN 'pinned' WHEN 1 THEN 'overridden' ELSE 'linked' END").alias("status"))
    late = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    changed = c.where("c_mktsegment = 'BUILDING'").join(late, c.c_custkey == late.o_custkey, "left_semi").select(F.col("c_nationkey").alias("query_id"))
    return sync.sync_report(sync.transition(state, changed))


@query
def invalidation_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("binding_id"), F.col("c_nationkey").alias("query_id"))
    changed = load(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("query_id"))
    return sync.invalidated(bindings, changed).select("binding_id", "query_id")


@query
def minimal_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    current = p.where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    resolved = p.where("p_partkey % 8 <> 0").select(F.col("p_partkey").alias("key"), F.expr("CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN p_brand ELSE p_name END").alias("value"))
    return sync.minimal_refresh(current, resolved)


@query
def variable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "customer").withColumn("nick", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")))
    nick = field(df, "nick")
    v, h = bind.variable(nick, "placeholder", "n/a"), bind.variable(nick, "hide")
    return df.select("c_custkey", v.display.alias("shown"), h.display.alias("or_blank"), h.hidden.alias("hidden"), bind.barcode_value(nick).status.alias("code_status"))


@query
def batch_plan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.plan_catalog(load(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@query
def batch_plan_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    return batch.plan_per_group(c, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "unit", "unit_label")


@query
def batch_plan_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.plan_per_record(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], "c_name").select("c_custkey", "unit", "unit_label")


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = load(spark, sf_dir, "part").select("p_type", "p_brand", "p_name", "p_partkey")
    return batch.run_batch(part, "p_type", ["p_brand"], CHAIN)


@query
def paginate_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _, _ = _catalog(spark, sf_dir)
    return placed.select("p_type", "p_brand", "p_partkey", "section_ord", "rec_no", "frame", "page", "y_pt")


@query
def paginate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pieces, rows = _catalog(spark, sf_dir)
    return layout.flow_summary(pieces, rows, "p_type")


def _nested(spark: SparkSession, sf_dir: str, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = load(spark, sf_dir, "part").select("p_type", "p_brand", "p_size", "p_partkey")
    return batch.run_batch(part, "p_type", ["p_brand", "p_size"], CHAIN, mode=mode, footer=True)


@query
def paginate_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of each type with brands and, within them, sizes; each size has a footer."""
    placed, _, _ = _nested(spark, sf_dir, "catalog")
    return placed.select("p_type", "p_brand", "p_size", "p_partkey", "section_ord", "rec_no", "frame", "page", "y_pt")


@query
def paginate_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where headers, runs of records and footers of those catalogues stand, by kind and level."""
    _, pieces, _ = _nested(spark, sf_dir, "catalog")
    return pieces.groupBy("p_type", "kind", "level").agg(F.count("*").alias("n"), F.sum(F.col("continued").cast("long")).alias("n_continued"), F.sum("y_pt").alias("sum_y"), F.max("frame_no").alias("last_frame"))


def _heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_type", "p_brand", "p_size", "p_partkey")
    return flow.run_flow(part, "p_type", ["p_brand", "p_size"], 400.0, (F.col("p_partkey") * 7 % 39 + 1).cast("double"), (F.col("n") % 20 + 10).cast("double"))


@query
def paginate_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those catalogues with a height for each part (1 to 39) and each footer (10 to 29)."""
    placed = _heights(spark, sf_dir)
    return placed.select(F.col("unit").alias("p_type"), "section_ord", "kind", "level", "rec_no", F.col("record.p_partkey").alias("p_partkey"), "frame_no", "y_pt")


@query
def paginate_heights_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their documents in 8 frames each: placed and left over, and the headers that frames repeat."""
    part = load(spark, sf_dir, "part").select("p_type", "p_brand", "p_size", "p_partkey")
    placed = flow.run_flow(part, "p_type", ["p_brand", "p_size"], 400.0, (F.col("p_partkey") * 7 % 39 + 1).cast("double"), (F.col("n") % 20 + 10).cast("double"), frames=8)
    repeated = flow.repeated_headers(placed).groupBy("unit").agg(F.count("*").alias("n_repeated"), F.count(F.when(F.col("continued"), 1)).alias("n_continued"))
    return flow.run_summary(placed).join(repeated, "unit", "left").select(F.col("unit").alias("p_type"), "placed", "total", "overflow", "frames", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.coalesce("n_continued", F.lit(0)).alias("n_continued"))


@query
def batch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each brand of each type, of two frames at most, with its label and what is left over."""
    part = load(spark, sf_dir, "part").select("p_type", "p_brand", "p_partkey")
    placed = flow.run_flow(part, "p_type", ["p_brand"], 60.0, (F.col("p_partkey") * 7 % 39 + 1).cast("double"), frames=2, mode="group")
    return flow.run_summary(placed, "group").select(F.col("unit").alias("p_type"), "section_ord", "label", "placed", "total", "overflow", "frames")


@query
def batch_run_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each section of those catalogues."""
    _, pieces, rows = _nested(spark, sf_dir, "group")
    return layout.flow_summary(pieces, rows, ["p_type", *batch.DOCUMENTS["group"]])


@query
def batch_run_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each part, under the header of its size."""
    placed, _, _ = _nested(spark, sf_dir, "record")
    return placed.select("p_type", "p_brand", "p_size", "p_partkey", "section_ord", "rec_no", "frame", "page", "y_pt")


@query
def table_layout_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_widths(load(spark, sf_dir, "part"), {"p_partkey": "Part", "p_name": "Name", "p_brand": "Brand of the part", "p_type": "Type"})


def _table(spark: SparkSession, sf_dir: str) -> layout.Table:
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return layout.table_layout(part, {"p_brand": "Brand of the part", "p_name": "Name", "p_partkey": "Part"}, ["p_brand", "p_partkey"])


@query
def table_layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).rows


@query
def table_layout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).rules


@query
def table_layout_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).box


def _catalog_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables = {t: load(spark, sf_dir, t) for t in TABLES}
    return govern.column_catalog(spark, tables), govern.column_profile(tables)


@query
def governed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, profile = _catalog_of(spark, sf_dir)
    return govern.governed_columns(catalog, sidecar(spark)).join(profile, ["table_name", "name"])


@query
def governance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, profile = _catalog_of(spark, sf_dir)
    return govern.drift(catalog, sidecar(spark)).join(profile, ["table_name", "name"], "left")


@query
def mapping_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, profile = _catalog_of(spark, sf_dir)
    return bind.suggestions(catalog).join(profile, ["table_name", "name"])


@query
def gtin_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    base = F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "4")
    k = F.col("p_partkey") % 5
    code = F.when(k == 0, F.concat(base, (F.col("p_partkey") % 10).cast("string"))).when(k == 1, F.concat(F.left(base, F.lit(11)), F.lit("x"))).when(k == 2, F.left(base, F.lit(9))).when(k == 3, F.lit("")).otherwise(base)
    a = codes.gtin_audit(code)
    return p.select("p_partkey", a.reason.alias("reason"), a.canonical.alias("canonical"))


@query
def code128_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.groupBy("lang", codes.code128_audit(F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


@query
def qr_version_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages")
    return p.groupBy(codes.qr_version(F.col("url")).alias("version")).agg(F.count("*").alias("n"))


@query
def event_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land as two snapshots; the second changes some values and drops some rows."""
    root = f"{shape.shared_folder(spark)}/quire-refresh-{uuid.uuid4().hex}"
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    after = e.where("event_id % 20 <> 0").withColumn("value", F.when(F.col("event_id") % 20 == 1, F.col("value") + 1).otherwise(F.col("value")))
    for snapshot, frame in enumerate((e, after)):
        land_rows(frame, f"{root}/landed", snapshot)
        land_marker(spark, f"{root}/landed", snapshot)
        refresh(spark, f"{root}/landed", e.schema, ["event_id"], f"{root}/state", leaves=32).awaitTermination()
    changes = spark.read.parquet(f"{root}/state/changes")
    return changes.select("batch", "change_type", "n")
