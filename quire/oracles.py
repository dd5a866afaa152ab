"""DuckDB SQL with the results of the registered queries, where SQL can express them."""

from __future__ import annotations

# Widths of three columns and the number of parts.
_BOX = """
WITH box AS (SELECT greatest(17, max(length(p_brand))) * 6.0::DOUBLE + 8 AS a, greatest(4, max(length(p_name))) * 6.0::DOUBLE + 8 AS b, greatest(4, max(length(CAST(p_partkey AS VARCHAR)))) * 6.0::DOUBLE + 8 AS c, count(*) AS n FROM part)
"""
PART_ORDER = "p_brand, p_partkey, p_name, p_type, p_size, p_retailprice"

# The columns of the given tables, as they stand in the files.
_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def _filled(table: str) -> str:
    names = _COLUMNS[table].split()
    return f"SELECT '{table}', unnest([{', '.join(repr(c) for c in names)}]), unnest([{', '.join(f'count({c})' for c in names)}]) FROM {table}"


_CATALOG = f"""
WITH live(table_name, ord, name, data_type) AS (
  SELECT table_name, column_index - 1, column_name,
         CASE WHEN data_type IN ('BIGINT','INTEGER') THEN 'int' WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type = 'DATE' THEN 'date' ELSE 'text' END
  FROM duckdb_columns() WHERE table_name IN ({", ".join(repr(t) for t in _COLUMNS)})),
side(table_name, name, label, description, data_type, provenance) AS (VALUES
  ('part','p_partkey','Part','Key of the part','int','erp'), ('part','p_name','Name',NULL,'text','erp'), ('part','p_retailprice','Price','List price','int','erp'), ('part','p_colour','Colour',NULL,'text','erp'),
  ('orders','o_orderkey','Order',NULL,'int','shop'), ('orders','o_orderdate',NULL,'Day of order','datetime','shop'), ('customer','c_acctbal','Balance',NULL,'text','crm'),
  ('events','ts','Time','When it happened','date','app'), ('documents','text','Text',NULL,'text','crawl'), ('embeddings','embedding','Vector',NULL,'float','model')),
filled(table_name, name, n_filled) AS (
  {" UNION ALL ".join(_filled(t) for t in _COLUMNS)})
"""

_DIFF = """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders),
old AS (SELECT * FROM o WHERE o_orderkey % 50 <> 1),
new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM o WHERE o_orderkey % 50 <> 2),
diff AS (SELECT coalesce(n.o_orderkey, p.o_orderkey) AS o_orderkey,
  CASE WHEN p.o_orderkey IS NULL THEN 'inserted' WHEN n.o_orderkey IS NULL THEN 'removed'
       WHEN p.o_custkey = n.o_custkey AND p.o_orderstatus = n.o_orderstatus THEN 'unchanged' ELSE 'updated' END AS change_type
  FROM old p FULL JOIN new n ON p.o_orderkey = n.o_orderkey)
"""


def _shown(x: str) -> str:
    """A double as text: whole numbers without a point."""
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def _flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 'TRUE' ELSE 'FALSE' END"


def _de(x: str) -> str:
    return f"translate({x}, ',.', '.,')"


def _pages(keys: str, order: str, records: str) -> str:
    """CTEs of a catalogue of each ``p_type`` in frames of 400 pt, headers of 16, records and footers of 20: ``r`` numbers records,
    ``walk`` places sections one after the other, ``placed`` has records, ``piece`` has all pieces. With two keys there are
    header-only sections of the first one, and the last ones have footers."""
    depth = keys.count(",") + 1
    top, footer = 16 * depth, int(depth > 1)
    each = (400 - top) // 20
    outer = f"UNION ALL SELECT p_type, min(ord) - 1, 0, 0, 0 FROM leaf GROUP BY p_type, {keys.split(',')[0]}" if depth > 1 else ""
    return f"""
WITH RECURSIVE r AS (
  SELECT *, dense_rank() OVER (PARTITION BY p_type ORDER BY {keys}) * {depth} - 1 AS ord, row_number() OVER (PARTITION BY p_type, {keys} ORDER BY {order}) - 1 AS rec_no FROM (SELECT {records} FROM part)),
leaf AS (SELECT p_type, {keys}, ord, count(*) AS n FROM r GROUP BY p_type, {keys}, ord),
q AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY ord) AS i FROM (SELECT p_type, ord, {depth - 1} AS level, n, {footer} AS footer FROM leaf {outer})),
walk AS (
  SELECT p_type, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS ord, 0 AS level, CAST(0 AS BIGINT) AS n, 0 AS footer, CAST(0 AS BIGINT) AS hf, CAST(0 AS BIGINT) AS hy, CAST(0 AS BIGINT) AS room, CAST(0 AS BIGINT) AS more, CAST(0 AS BIGINT) AS ff, CAST(0 AS BIGINT) AS fy, CAST(0 AS BIGINT) AS used
  FROM (SELECT DISTINCT p_type FROM part)
  UNION ALL
  SELECT p_type, i, ord, level, n, footer, hf, hy, room, more, hf + more + CAST(turn AS INTEGER), CASE WHEN turn THEN 0 ELSE u2 END, CASE WHEN turn THEN 0 ELSE u2 END + 20 * footer
  FROM (SELECT *, footer = 1 AND u2 + 20 > 400 AS turn
  FROM (SELECT *, CASE WHEN n <= room THEN 0 ELSE (n - room + {each - 1}) // {each} END AS more, CASE WHEN n <= room THEN hy + 16 + 20 * n ELSE {top} + 20 * (n - room - {each} * ((n - room - 1) // {each})) END AS u2
  FROM (SELECT *, (384 - hy) // 20 AS room
  FROM (SELECT q.*, w.ff + CAST(w.used + 16 > 400 AS INTEGER) AS hf, CASE WHEN w.used + 16 > 400 THEN 0 ELSE w.used END AS hy FROM walk w JOIN q ON q.p_type = w.p_type AND q.i = w.i + 1))))),
placed AS (
  SELECT r.*, CASE WHEN rec_no < room THEN hf ELSE hf + 1 + (rec_no - room) // {each} END AS frame_no, CAST(CASE WHEN rec_no < room THEN hy + 16 + 20 * rec_no ELSE {top} + 20 * ((rec_no - room) % {each}) END AS DOUBLE) AS y_pt
  FROM r JOIN walk w ON r.p_type = w.p_type AND r.ord = w.ord),
turned AS (SELECT *, unnest(range(1, more + 1)) AS j FROM walk WHERE more > 0),
piece AS (
  SELECT p_type, 'header' AS kind, level, 0 AS continued, hy AS y, hf AS f FROM walk WHERE i > 0
  UNION ALL SELECT p_type, 'header', lv, CAST(room + {each} * (j - 1) > 0 AS INTEGER), 16 * lv, hf + j FROM turned, unnest(range({depth})) AS t(lv)
  UNION ALL SELECT p_type, 'records', level, 0, hy + 16, hf FROM walk WHERE n > 0 AND room > 0
  UNION ALL SELECT p_type, 'records', level, 0, {top}, hf + j FROM turned
  UNION ALL SELECT p_type, 'footer', level, 0, fy, ff FROM walk WHERE footer = 1)"""


_FRAME = "'f' || CAST(frame_no AS BIGINT) AS frame, 'p' || CAST(frame_no // 2 AS BIGINT) AS page, y_pt"
_BY_BRAND = _pages("p_brand", "p_name, p_partkey", "p_type, p_brand, p_name, p_partkey")
_NESTED = _pages("p_brand, p_size", "p_partkey", "p_type, p_brand, p_size, p_partkey")

# Elements in order, placed one after the other: heights of parts follow their keys, those of footers the section's records.
_HEIGHTS = """
WITH RECURSIVE r AS (
  SELECT *, dense_rank() OVER (PARTITION BY p_type ORDER BY p_brand, p_size) * 2 - 1 AS ord, row_number() OVER (PARTITION BY p_type, p_brand, p_size ORDER BY p_partkey) - 1 AS rec_no FROM (SELECT p_type, p_brand, p_size, p_partkey FROM part)),
leaf AS (SELECT p_type, p_brand, ord, count(*) AS n FROM r GROUP BY ALL),
e AS (
  SELECT p_type, min(ord) - 1 AS ord, 'header' AS kind, 0 AS level, 0 AS rec_no, 16 AS h, NULL AS p_partkey FROM leaf GROUP BY p_type, p_brand
  UNION ALL SELECT p_type, ord, 'header', 1, 0, 16, NULL FROM leaf
  UNION ALL SELECT p_type, ord, 'record', 1, rec_no, p_partkey * 7 % 39 + 1, p_partkey FROM r
  UNION ALL SELECT p_type, ord, 'footer', 1, n, n % 20 + 10, NULL FROM leaf),
q AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY ord, CASE kind WHEN 'header' THEN 0 WHEN 'record' THEN 1 ELSE 2 END, rec_no) AS i FROM e),
w AS (
  SELECT p_type, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS used FROM (SELECT DISTINCT p_type FROM q)
  UNION ALL
  SELECT p_type, i, f, y, y + h FROM (
    SELECT q.p_type, q.i, q.h, w.f + CAST(w.used + q.h > 400 AS INTEGER) AS f, CASE WHEN w.used + q.h <= 400 THEN w.used WHEN q.kind = 'record' AND 32 + q.h <= 400 THEN 32 ELSE 0 END AS y
    FROM w JOIN q ON q.p_type = w.p_type AND q.i = w.i + 1)),
place AS (SELECT q.*, w.f AS frame_no, w.y, coalesce(lag(w.f) OVER (PARTITION BY q.p_type ORDER BY q.i), 0) < w.f AND q.kind = 'record' AS turns FROM q JOIN w USING (p_type, i))
"""

SQL: dict[str, str] = {
    "brand_sections": "SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY p_brand) - 1 AS section_ord, count(*) || ' items' AS label, format('{:,.2f}', sum(l_extendedprice)) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "section_aggregates": " UNION ALL ".join(f"SELECT p_brand, p_type, count(*) AS n, '{f}' AS agg, format('{{:,.2f}}', CAST({f}(p_size) AS DOUBLE)) AS total FROM part GROUP BY p_brand, p_type" for f in ("avg", "min", "max")),
    "nested_section_headers": """
WITH g AS (SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type) - 1 AS section_ord FROM (SELECT DISTINCT p_brand, p_type FROM part)),
c AS (SELECT *, lag(p_brand) OVER (ORDER BY section_ord) IS DISTINCT FROM p_brand AS first FROM g)
SELECT section_ord, CAST(0 AS INTEGER) AS level, p_brand AS text, FALSE AS leaf FROM c WHERE first
UNION ALL SELECT section_ord, CAST(1 AS INTEGER), p_type, TRUE FROM c""",
    "section_stream": f"""
WITH g AS (SELECT p_brand, count(*) AS n, sum(p_retailprice) AS s, row_number() OVER (ORDER BY p_brand) - 1 AS section_ord FROM part GROUP BY p_brand),
r AS (SELECT *, row_number() OVER (ORDER BY {PART_ORDER}) - 1 AS row_idx FROM part)
SELECT section_ord, CAST(0 AS INTEGER) AS kind, CAST(0 AS INTEGER) AS level, CAST(-1 AS BIGINT) AS row_idx, p_brand AS cells FROM g
UNION ALL SELECT section_ord, CAST(1 AS INTEGER), CAST(0 AS INTEGER), row_idx, p_name || '|Price $' || format('{{:,.2f}}', p_retailprice) FROM r JOIN g USING (p_brand)
UNION ALL SELECT section_ord, CAST(2 AS INTEGER), CAST(0 AS INTEGER), CAST(-1 AS BIGINT), n || ' items|' || format('{{:,.2f}}', s) FROM g""",
    "text_export": """
WITH l AS (SELECT 'o_orderkey' || chr(9) || 'o_orderstatus' AS line UNION ALL SELECT o_orderkey || chr(9) || coalesce(o_orderstatus, '') FROM orders)
SELECT count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, count(*) FILTER (starts_with(line, 'o_')) AS n_headers, TRUE AS header_first FROM l""",
    "packed_orders": """
SELECT l_orderkey, count(*) AS n_rows, CAST(sum(l_quantity) AS DOUBLE) AS quantity, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS line_numbers FROM lineitem GROUP BY l_orderkey""",
    "landed_tree_keys": """
WITH t AS (SELECT o_orderkey // 8192 AS export, string_agg(o_orderkey || chr(9) || o_custkey || chr(9) || o_orderstatus || chr(10), '' ORDER BY o_orderkey) AS body FROM orders GROUP BY 1),
b AS (SELECT export, body, unnest(range(0, CAST((length(body) + 4095) // 4096 AS BIGINT))) AS node FROM t),
leaf AS (SELECT export, length(body) AS n_bytes, node, sha256(substr(body, CAST(node * 4096 + 1 AS BIGINT), 4096)) AS digest FROM b),
up AS (SELECT export, n_bytes, node // 4 AS node, count(*) AS n, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM leaf GROUP BY export, n_bytes, node // 4)
SELECT export, n_bytes, CAST(sum(n) AS BIGINT) AS n_blocks, sha256(string_agg(digest, '' ORDER BY node)) AS root FROM up GROUP BY export, n_bytes""",
    "formatted_price_list": f"""
SELECT row_number() OVER (ORDER BY {PART_ORDER}) - 1 AS row_idx, p_name AS name, '$' || format('{{:,.2f}}', p_retailprice) AS price, {_de("format('{:,.2f}', p_retailprice)")} || ' €' AS price_de,
  format('{{:,.0f}}', p_retailprice) AS rounded, format('{{:,.1f}}', p_size / 50.0::DOUBLE * 100) || '%' AS share FROM part""",
    "text_kernels": """
SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, CAST(length(c_name) AS VARCHAR) AS n, left(c_mktsegment, 3) AS first, right(c_name, 4) AS last, substr(c_name, 2, 5) AS middle,
  upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS proper, replace(c_name, '0', 'o') AS sub, CASE WHEN instr(c_name, 'u') > 0 THEN CAST(instr(c_name, 'u') AS VARCHAR) ELSE '#VALUE' END AS at,
  CASE WHEN instr(c_name, '@') > 0 THEN CAST(instr(c_name, '@') AS VARCHAR) ELSE '#VALUE' END AS lost, c_mktsegment || ' - ' || c_name AS joined, c_mktsegment || c_mktsegment AS twice, c_mktsegment AS trimmed, c_name || '/' || c_mktsegment AS both FROM customer""",
    "math_kernels": f"""
SELECT o_orderkey, {_shown("abs(o_totalprice - 1000.0)")} AS abs, {_shown("floor(o_totalprice + 0.5)")} AS rounded, {_shown("floor(o_totalprice)")} AS floor, {_shown("ceil(o_totalprice)")} AS ceil, {_shown("trunc(o_totalprice)")} AS trunc,
  CAST((7 - o_orderkey % 7) % 7 AS VARCHAR) AS mod, '#DIV/0' AS mod0, CAST((o_orderkey % 10) * (o_orderkey % 10) * (o_orderkey % 10) AS VARCHAR) AS pow, CAST(sign(o_custkey - 100) AS VARCHAR) AS sign,
  CAST(least(o_orderkey, o_custkey) AS VARCHAR) AS least, CAST(greatest(o_orderkey, o_custkey) AS VARCHAR) AS most, CAST(o_orderkey + o_custkey AS VARCHAR) AS sum FROM orders""",
    "logic_kernels": f"""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS state, {_flag("c_acctbal < 0 AND c_nationkey > 10")} AS both, {_flag("c_acctbal < 0 OR c_nationkey > 10")} AS either, {_flag("c_acctbal >= 0")} AS neither,
  {_flag("c_mktsegment IS NULL OR c_mktsegment = ''")} AS blank, {_flag("c_nationkey = 0")} AS bad, c_mktsegment AS first, CASE c_nationkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'other' END AS region,
  CASE WHEN c_nationkey = 0 THEN '-1' ELSE {_shown("100.0::DOUBLE / nullif(c_nationkey, 0)")} END AS safe, {_flag("c_nationkey = 5")} AS same FROM customer""",
    "date_kernels": """
SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(month(o_orderdate) AS VARCHAR) AS m, CAST(day(o_orderdate) AS VARCHAR) AS d, CAST(dayofweek(o_orderdate) + 1 AS VARCHAR) AS wd,
  strftime(o_orderdate, '%Y-%m-%d') AS shown, strftime(o_orderdate, '%d.%m.%Y') AS de, strftime(o_orderdate, '%d/%m/%y') AS own, '2026-06-08' AS run FROM orders""",
    "sql_recipe": """
SELECT p_partkey, '$' || format('{:,.2f}', p_retailprice) AS price, format('{:,.1f}', p_size / 50.0::DOUBLE * 100) || '%' AS share, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS rounded, CAST(ceil(-p_retailprice) AS BIGINT) AS cut,
  (7 - p_partkey % 7) % 7 AS rest, CAST(NULL AS DOUBLE) AS none, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS kind,
  CAST(nullif(instr(p_brand, '#'), 0) AS INTEGER) AS at, substr(p_name, 2, 4) AS part, right(p_name, 3) AS end, TRUE AS blank FROM part""",
    "catalog_join_params": """
SELECT p.p_brand, n.n_name, count(*) AS n_lines, CAST(round(sum(l.l_quantity)) AS BIGINT) AS qty
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
WHERE p.p_size >= 10 AND l.l_shipdate >= DATE '1995-01-01' GROUP BY p.p_brand, n.n_name""",
    "single_record": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1",
    "nth_record": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 41",
    "scalar_total": "SELECT count(*) AS value FROM orders WHERE o_orderstatus = (SELECT min(o_orderstatus) FROM orders)",
    "stable_row_index": "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS row_idx FROM lineitem",
    "appended_row_index": "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS row_idx FROM lineitem",
    "resolve_plan": "SELECT c_custkey AS binding_id FROM customer WHERE c_custkey % 10 = 0 OR c_nationkey % 5 = 1 OR c_custkey % 7 = 0 AND c_mktsegment <> 'all'",
    "grouped_first_seen": "SELECT o_orderpriority, count(*) AS n, min(i) AS first_seen FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey, o_orderpriority) - 1 AS i FROM orders) GROUP BY o_orderpriority",
    "rule_fires": """
WITH r AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS row_idx FROM lineitem)
SELECT 'small' AS rule, row_idx, row_idx + 1 AS table_row FROM r WHERE l_quantity < 5 UNION ALL SELECT 'dear', row_idx, row_idx + 1 FROM r WHERE l_extendedprice > 50000""",
    "rule_cells": """
WITH r AS (SELECT *, row_number() OVER (ORDER BY p_partkey, p_name, p_size, p_retailprice) + 1 AS row FROM part)
SELECT row, 2 AS col, 'Compact' AS style FROM r WHERE p_size < 5 UNION ALL SELECT row, 3, 'Warning' FROM r WHERE p_retailprice > 1500""",
    "content_revision": """
SELECT count(*) AS n_rows, (SELECT left(sha256('["' || string_agg(column_name, '", "' ORDER BY column_index) || '"]'), 16) FROM duckdb_columns() WHERE table_name = 'lineitem') AS schema_hash,
  TRUE AS same_in_other_order, count(*) FILTER (l_orderkey % 1000 = 1 AND l_quantity IS NOT NULL) = 0 AS same_after_change FROM lineitem""",
    "event_refresh": """
SELECT 0 AS batch, 'inserted' AS change_type, count(*) AS n FROM events
UNION ALL SELECT 1, CASE WHEN event_id % 20 = 0 THEN 'removed' WHEN event_id % 20 = 1 AND value IS NOT NULL THEN 'updated' ELSE 'unchanged' END, count(*) FROM events GROUP BY 2""",
    "rule_totals": " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(count(*) FILTER ({c}) AS BIGINT) AS fired, count(*) AS total FROM lineitem" for n, c in (("few", "l_quantity < 5"), ("many", "l_quantity >= 45"), ("returned", "l_returnflag = 'R'"))),
    "image_reference_audit": """
WITH r AS (SELECT CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'asset:' || page_id WHEN 3 THEN 'img/a.png' ELSE url END AS ref FROM pages),
i AS (SELECT CASE WHEN coalesce(ref, '') = '' OR starts_with(ref, 'asset:') THEN 'asset' WHEN regexp_matches(ref, '^https?://') THEN 'uri' ELSE 'path' END AS kind,
  CASE WHEN coalesce(ref, '') = '' THEN 'none' WHEN starts_with(ref, 'asset:') THEN substr(ref, 7) ELSE ref END AS ref, CASE WHEN coalesce(ref, '') = '' THEN 'fallback' ELSE 'ok' END AS status FROM r)
SELECT kind, status, count(*) AS n, count(*) FILTER (kind IN ('uri', 'path')) AS placeable, count(DISTINCT ref) AS refs FROM i GROUP BY kind, status""",
    "origin_allowlist": """
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) AS origin FROM pages), a AS (SELECT DISTINCT origin FROM p WHERE page_id % 5 = 0)
SELECT page_id, p.origin, a.origin IS NOT NULL AS allowed, CASE WHEN a.origin IS NOT NULL THEN 'consented' ELSE 'notConsented' END AS reason FROM p LEFT JOIN a ON p.origin = a.origin""",
    "url_audit": """
SELECT CASE page_id % 6 WHEN 0 THEN 'badScheme' WHEN 1 THEN 'noScheme' WHEN 2 THEN 'embeddedCredentials' WHEN 3 THEN 'emptyHost' ELSE 'ok' END AS reason, count(*) AS n FROM pages GROUP BY ALL""",
    "row_diff": _DIFF + "SELECT o_orderkey, change_type FROM diff",
    "row_diff_summary": _DIFF + "SELECT change_type, count(*) AS n FROM diff GROUP BY change_type",
    "merkle_diff": """
SELECT o_orderkey, CASE o_orderkey % 50 WHEN 1 THEN 'inserted' WHEN 2 THEN 'removed' ELSE 'updated' END AS change_type FROM orders
WHERE o_orderkey // 1000 % 5 = 0 AND (o_orderkey % 50 IN (1, 2) OR o_orderkey % 50 = 3 AND o_orderstatus IS DISTINCT FROM 'X')""",
    "incremental_revision": "SELECT o_orderkey // 1000 AS leaf, count(*) AS n, TRUE AS same FROM orders WHERE o_orderkey // 1000 % 5 <> 0 OR o_orderkey % 50 <> 2 GROUP BY 1",
    "row_diff_multiset": """
WITH old AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 40 <> 1), new AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 40 <> 2)
SELECT * FROM (SELECT CASE WHEN o.l_orderkey IS NULL THEN 'inserted' ELSE 'unchanged' END AS change_type, count(*) AS n FROM new n LEFT JOIN old o USING (l_orderkey, l_linenumber) GROUP BY 1
UNION ALL SELECT 'removed', count(*) FROM old o ANTI JOIN new n USING (l_orderkey, l_linenumber)) WHERE n > 0""",
    "change_report": """
WITH b AS (SELECT o_custkey % 97 AS k, list(o_orderkey || o_orderstatus ORDER BY o_orderkey, o_orderstatus) AS x FROM orders WHERE o_custkey % 97 <> 5 GROUP BY 1),
a AS (SELECT o_custkey % 97 AS k, list(o_orderkey || CASE WHEN o_custkey % 97 % 10 = 3 THEN 'X' ELSE o_orderstatus END ORDER BY o_orderkey, o_orderstatus) AS x FROM orders WHERE o_custkey % 97 <> 6 GROUP BY 1)
SELECT 'cust-' || coalesce(a.k, b.k) AS binding_id, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.x = b.x THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.k = b.k""",
    "sync_transition": """
WITH s AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 5 WHEN 0 THEN 'pinned' WHEN 1 THEN 'overridden' ELSE CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0) THEN 'stale' ELSE 'linked' END END AS status FROM customer)
SELECT c_custkey AS binding_id, c_nationkey AS query_id, CASE WHEN c_custkey % 11 <> 0 THEN status WHEN c_custkey % 4 = 0 THEN 'pinned' WHEN c_custkey % 4 = 1 THEN 'overridden' WHEN c_custkey % 4 = 2 THEN 'stale'
  WHEN status IN ('pinned', 'overridden') THEN status ELSE 'linked' END AS status FROM s""",
    "sync_stamps": """
WITH t AS (SELECT s_nationkey, count(*) AS stamp FROM supplier GROUP BY s_nationkey), s AS (SELECT c_custkey, c_nationkey, c_custkey % 5 IN (0, 1) AS held, c_custkey % 3 = 0 AS asked, stamp FROM customer LEFT JOIN t ON c_nationkey = s_nationkey)
SELECT c_custkey AS binding_id, c_nationkey AS query_id, CASE WHEN c_custkey % 5 = 0 THEN 'pinned' WHEN c_custkey % 5 = 1 THEN 'overridden' WHEN asked THEN 'linked' ELSE 'stale' END AS status,
  CASE WHEN asked AND NOT held THEN stamp WHEN c_custkey % 2 = 0 THEN CAST(0 AS BIGINT) END AS last_resolved FROM s""",
    "sync_report": """
WITH hit AS (SELECT DISTINCT c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT')
SELECT c_custkey AS binding_id, CASE c_custkey % 7 WHEN 0 THEN 'pinned' WHEN 1 THEN 'overridden' ELSE 'stale' END AS status FROM customer WHERE c_custkey % 7 < 2 OR c_nationkey IN (SELECT c_nationkey FROM hit)""",
    "inline_seed": """
SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END AS word, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag""",
    "bound_parameters": "SELECT p_partkey, p_size * 1.5::DOUBLE AS price, 'net ' || p_size AS shown, TRUE AS absent FROM part",
    "mixed_cells": """
WITH e AS (SELECT event_id, event_id % 6 AS m, value, CAST(value AS VARCHAR) AS v, event_type, props, CAST(regexp_extract(props, ': (\\d+)', 1) AS DOUBLE) AS k, regexp_extract(props, ': (\\d+)', 1) AS kt FROM events),
c AS (SELECT *, CASE m WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN CAST(event_id % 12 = 2 AS INTEGER) WHEN 3 THEN 0 END AS x,
  CASE m WHEN 0 THEN regexp_replace(v, '\\.0$', '') WHEN 1 THEN v WHEN 2 THEN CASE WHEN event_id % 12 = 2 THEN 'TRUE' ELSE 'FALSE' END WHEN 3 THEN '' WHEN 4 THEN event_type ELSE replace(props, ': ', ':') END AS shown FROM e)
SELECT event_id, shown, x + k AS total, CASE WHEN m > 3 THEN '#TYPE' END AS total_error, CASE WHEN m = 3 THEN FALSE WHEN m > 3 THEN shown = kt ELSE x = k END AS same, CASE WHEN m > 3 THEN shown < kt ELSE x < k END AS less, m = 3 AS blank FROM c""",
    "batch_plan_catalog": "SELECT c_custkey, c_name, CAST(0 AS BIGINT) AS unit, 'catalog' AS unit_label FROM customer",
    "invalidation_cut": "SELECT c_custkey AS binding_id, c_nationkey AS query_id FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)",
    "minimal_refresh": """
WITH r AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN p_brand ELSE p_name END AS value, p_name AS old, p_partkey % 9 <> 0 AS had FROM part WHERE p_partkey % 8 <> 0)
SELECT key, value FROM r WHERE NOT had OR value IS DISTINCT FROM old""",
    "variable_values": """
SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE 'n/a' END AS shown, CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE '' END AS or_blank, c_custkey % 4 = 0 AS hidden,
  CASE WHEN c_custkey % 4 <> 0 THEN 'ok' ELSE 'flagged' END AS code_status FROM customer""",
    "batch_plan_per_group": "SELECT c_custkey, dense_rank() OVER (ORDER BY c_nationkey, c_mktsegment) - 1 AS unit, c_nationkey || ' / ' || c_mktsegment AS unit_label FROM customer",
    "batch_plan_per_record": "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS unit, c_name AS unit_label FROM customer",
    "table_layout_rows": """
SELECT row_number() OVER (ORDER BY p_brand, p_partkey, p_name, p_type) AS row_no, FALSE AS header, 14.0::DOUBLE * row_number() OVER (ORDER BY p_brand, p_partkey, p_name, p_type) AS y_pt, 14.0::DOUBLE AS height_pt, concat_ws(chr(9), p_brand, p_name, p_partkey) AS text FROM part
UNION ALL SELECT 0, TRUE, 0, 14, concat_ws(chr(9), 'Brand of the part', 'Name', 'Part')""",
    "table_layout_rules": _BOX + """
SELECT 'row' AS rule, 0.0::DOUBLE AS x1_pt, 14.0::DOUBLE * i AS y1_pt, a + b + c AS x2_pt, 14.0::DOUBLE * i AS y2_pt FROM box, LATERAL (SELECT unnest(range(n + 2)) AS i)
UNION ALL SELECT 'column', x, 0, x, 14.0::DOUBLE * (n + 1) FROM box, LATERAL (SELECT unnest([0.0::DOUBLE, a, a + b, a + b + c]) AS x)""",
    "table_layout_box": _BOX + "SELECT CAST(3 AS BIGINT) AS n_columns, n + 1 AS n_rows, a + b + c AS width_pt, 14.0::DOUBLE * (n + 1) AS height_pt FROM box",
    "table_layout_widths": """
WITH w(ord, name, chars) AS (SELECT 0, 'p_partkey', greatest(4, max(length(CAST(p_partkey AS VARCHAR)))) FROM part UNION ALL SELECT 1, 'p_name', greatest(4, max(length(p_name))) FROM part
  UNION ALL SELECT 2, 'p_brand', greatest(17, max(length(p_brand))) FROM part UNION ALL SELECT 3, 'p_type', greatest(4, max(length(p_type))) FROM part)
SELECT CAST(ord AS INTEGER) AS ord, name, chars * 6.0::DOUBLE + 8 AS width_pt, coalesce(sum(chars * 6.0::DOUBLE + 8) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS x_pt FROM w""",
    "governed_columns": _CATALOG + """
SELECT l.table_name, l.name, CAST(l.ord AS INTEGER) AS ord, l.data_type, coalesce(s.label, l.name) AS label, s.description, s.provenance, s.name IS NOT NULL AS documented, f.n_filled
FROM live l LEFT JOIN side s ON l.table_name = s.table_name AND l.name = s.name JOIN filled f ON l.table_name = f.table_name AND l.name = f.name""",
    "governance_drift": _CATALOG + """
SELECT coalesce(l.table_name, s.table_name) AS table_name, coalesce(l.name, s.name) AS name, CASE WHEN s.name IS NULL THEN 'undocumentedColumn' WHEN l.name IS NULL THEN 'missingColumn' ELSE 'typeMismatch' END AS diagnostic,
  s.data_type AS documented, l.data_type AS actual, f.n_filled FROM live l FULL JOIN side s ON l.table_name = s.table_name AND l.name = s.name LEFT JOIN filled f ON f.table_name = coalesce(l.table_name, s.table_name) AND f.name = coalesce(l.name, s.name)
WHERE s.name IS NULL OR l.name IS NULL OR s.data_type <> l.data_type""",
    "mapping_suggestions": _CATALOG + """
SELECT l.table_name, l.name, array_to_string(list_transform(string_split(l.name, '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS header, l.name AS expr, l.data_type, TRUE AS mappable, f.n_filled
FROM live l JOIN filled f ON l.table_name = f.table_name AND l.name = f.name""",
    "gtin_audit": """
WITH c AS (SELECT p_partkey, right('444444444444' || (p_partkey * 7919), 12) AS base FROM part), d AS (SELECT *, (10 - (
  list_sum(list_transform(range(1, 13), lambda i: CAST(substr(base, CAST(i AS INTEGER), 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))) % 10) % 10 AS k FROM c)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN k = p_partkey % 10 THEN 'ok' ELSE 'checkDigit' END WHEN 1 THEN 'nonDigit' WHEN 2 THEN 'wrongLength' WHEN 3 THEN 'empty' ELSE 'ok' END AS reason,
  CASE WHEN p_partkey % 5 = 4 OR (p_partkey % 5 = 0 AND k = p_partkey % 10) THEN base || CAST(k AS BIGINT) END AS canonical FROM d""",
    "code128_audit": "SELECT lang, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN regexp_full_match(text, '[\\x20-\\x7F]+') THEN 'ok' ELSE 'notEncodable' END AS reason, count(*) AS n FROM documents GROUP BY ALL",
    "qr_version_histogram": """
WITH b AS (SELECT strlen(url) AS n FROM pages)
SELECT CAST(CASE WHEN n = 0 THEN NULL WHEN 12 + 8 * n <= 128 THEN 1 WHEN 12 + 8 * n <= 224 THEN 2 WHEN 12 + 8 * n <= 352 THEN 3 WHEN 12 + 8 * n <= 512 THEN 4 WHEN 12 + 8 * n <= 688 THEN 5 WHEN 12 + 8 * n <= 864 THEN 6
  WHEN 12 + 8 * n <= 992 THEN 7 WHEN 12 + 8 * n <= 1232 THEN 8 WHEN 12 + 8 * n <= 1456 THEN 9 WHEN 20 + 8 * n <= 1728 THEN 10 END AS INTEGER) AS version, count(*) AS n FROM b GROUP BY 1""",
    "paginate_catalog": _BY_BRAND + f" SELECT p_type, p_brand, p_partkey, ord AS section_ord, rec_no, {_FRAME} FROM placed",
    "paginate_summary": _BY_BRAND + " SELECT p_type, CAST(sum(n) AS BIGINT) AS placed, CAST(sum(n) AS BIGINT) AS total, FALSE AS overflow, CAST(max(ff) + 1 AS BIGINT) AS frames FROM walk GROUP BY p_type",
    "paginate_nested": _NESTED + f" SELECT p_type, p_brand, p_size, p_partkey, ord AS section_ord, rec_no, {_FRAME} FROM placed",
    "paginate_pieces": _NESTED + " SELECT p_type, kind, level, count(*) AS n, CAST(sum(continued) AS BIGINT) AS n_continued, CAST(sum(y) AS DOUBLE) AS sum_y, CAST(max(f) AS BIGINT) AS last_frame FROM piece GROUP BY p_type, kind, level",
    "paginate_heights": _HEIGHTS + "SELECT p_type, CAST(ord AS BIGINT) AS section_ord, kind, CAST(level AS INTEGER) AS level, CAST(rec_no AS BIGINT) AS rec_no, p_partkey, frame_no, CAST(y AS DOUBLE) AS y_pt FROM place",
    "paginate_heights_summary": _HEIGHTS + """
SELECT p_type, count(*) FILTER (kind = 'record' AND frame_no < 8) AS placed, count(*) FILTER (kind = 'record') AS total, bool_or(frame_no >= 8) AS overflow, count(DISTINCT frame_no) FILTER (frame_no < 8) AS frames,
  CAST(2 * count(*) FILTER (turns AND frame_no < 8) AS BIGINT) AS n_repeated, CAST(2 * count(*) FILTER (turns AND frame_no < 8 AND rec_no > 0) AS BIGINT) AS n_continued FROM place GROUP BY p_type""",
    # Each brand alone: its header, then its parts, under the header again in later frames.
    "batch_runs": """
WITH RECURSIVE r AS (SELECT p_type, p_brand, p_partkey * 7 % 39 + 1 AS h, dense_rank() OVER (PARTITION BY p_type ORDER BY p_brand) - 1 AS ord, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS i FROM part),
w AS (SELECT p_type, ord, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS f, CAST(16 AS BIGINT) AS used FROM (SELECT DISTINCT p_type, ord FROM r)
  UNION ALL SELECT r.p_type, r.ord, r.i, w.f + CAST(w.used + r.h > 60 AS INTEGER), CASE WHEN w.used + r.h > 60 THEN 16 ELSE w.used END + r.h FROM w JOIN r ON r.p_type = w.p_type AND r.ord = w.ord AND r.i = w.i + 1)
SELECT p_type, ord AS section_ord, any_value(p_brand) AS label, count(*) FILTER (f < 2) AS placed, count(*) AS total, bool_or(f >= 2) AS overflow, count(DISTINCT f) FILTER (f < 2) AS frames FROM r JOIN w USING (p_type, ord, i) GROUP BY p_type, ord""",
    # A section alone has one header; 19 records fit under it, and a footer if there are 18 at most.
    "batch_run_per_group": _NESTED + " SELECT p_type, ord AS section_ord, n AS placed, n AS total, FALSE AS overflow, CASE WHEN n = 0 THEN 1 ELSE (n + 18) // 19 + CAST(n % 19 = 0 AS INTEGER) END AS frames FROM q",
    "batch_run_per_record": _NESTED + " SELECT p_type, p_brand, p_size, p_partkey, ord AS section_ord, rec_no, 'f0' AS frame, 'p0' AS page, CAST(16 AS DOUBLE) AS y_pt FROM r",
}
