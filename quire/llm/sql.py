"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

_OP3 = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS t FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM doc, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT doc_id, i, place.l AS l, item_id FROM place JOIN win ON place.t = win.t AND place.l = win.l),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(deg.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM part LEFT JOIN deg USING (vec_id)
"""

_OP5 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM doc WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM pair JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT doc_id, doc_id FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
part AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM part LEFT JOIN n USING (doc_id)
"""

_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')"

_OP10 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
k AS (SELECT *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]')) + 4 AS t, row_number() OVER w AS seq FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, sum(t) OVER (PARTITION BY conv_id ORDER BY seq) AS stop, coalesce(max(t) FILTER (seq = 1 AND role = 'system') OVER (PARTITION BY conv_id), 0) AS sys, lead(t) OVER (PARTITION BY conv_id ORDER BY seq) AS next FROM k),
q AS (SELECT *, seq = 1 AND sys > 0 AS first, greatest(1, (512 - sys - 128) // 2) AS half FROM p),
c AS (SELECT *, CAST(CASE WHEN first THEN stop ELSE stop - t END AS BIGINT) // half AS cell, coalesce(CASE WHEN first THEN next ELSE t END > half, FALSE) AS long FROM q),
r AS (SELECT *, min(seq) OVER g AS win, count(*) OVER g AS wn, max(stop) OVER g - stop + t AS tail, 512 - sys - coalesce(sum(t) FILTER (NOT first) OVER g, 0) AS room FROM c WINDOW g AS (PARTITION BY conv_id, cell, long)),
w AS (SELECT DISTINCT conv_id, win + wn AS after, win, room FROM r),
x AS (SELECT r.*, n.room AS after_room, count(DISTINCT r.win) OVER (PARTITION BY r.conv_id) AS n_win FROM r LEFT JOIN w n ON r.conv_id = n.conv_id AND r.win + r.wn = n.win),
y AS (SELECT *, 1 + CASE WHEN first THEN n_win - 1 WHEN win + wn - seq <= 2 AND after_room IS NOT NULL AND tail <= least(128, after_room) THEN 1 ELSE 0 END AS copies FROM x)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(copies * (length({_ESC.format("text")}) + length({_ESC.format("role")}) + 11)) AS BIGINT) AS formatted_chars
FROM y GROUP BY conv_id
"""

# crc32 of decimal ids, bit by bit: DuckDB has none. A fold over the digits' bytes.
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda s, c: list_reduce(list_prepend(xor(s, c), [CAST(0 AS UBIGINT) for i in range(8)]), lambda x, z: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1))))"

_OP11 = f"""
WITH t AS (SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS u, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(u ORDER BY i) AS us, CAST(xor({_CRC}, CAST(4294967295 AS UBIGINT)) % 4 AS BIGINT) AS h FROM t GROUP BY conv_id),
c AS (SELECT o.conv_id, list_concat(coalesce(b.us[1 : o.h], []), o.us[o.h + 1 :]) AS us FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
p AS (SELECT conv_id, len(us) AS total, us, unnest(range(0, len(us) + 1)) AS depth FROM c),
m AS (SELECT conv_id, depth, total, us[1 : depth] AS g, CASE WHEN depth > 0 THEN us[1 : depth - 1] END AS up, CASE WHEN depth > 0 THEN len(regexp_extract_all(us[depth].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM p),
n AS (SELECT g, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS gain, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256 FROM m GROUP BY g, depth),
k AS (SELECT up AS g, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (g)),
s AS (SELECT a AS g, sum(gain) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT g[1 : unnest(range(0, depth + 1))] AS a, gain, n_children FROM x) GROUP BY a)
SELECT x.conv_id, x.depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256 FROM x JOIN s USING (g) LEFT JOIN n y ON x.depth > 0 AND y.g = x.up
"""

# Strings of 200 bytes as 400 hexadecimal digits; `o` counts bytes from 0.
_OP12 = """
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT r, b, substr(x, 2 * b + 1, 1422) AS y FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199, 512)) AS b FROM doc WHERE len(x) >= 400)),
s AS (SELECT r, b + j AS o, md5_number(substr(y, 2 * j + 1, 400)) AS h FROM (SELECT r, b, y, unnest(range(0, least(512, len(y) // 2 - 199))) AS j FROM part)),
twice AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, o FROM s SEMI JOIN twice USING (h)),
mark AS (SELECT r, o, o - lag(o, 1, -1000) OVER (PARTITION BY r ORDER BY o) > 200 AS fresh FROM hit),
run AS (SELECT r, min(o) AS a, max(o) + 200 AS z FROM (SELECT r, o, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY o) AS k FROM mark) GROUP BY r, k),
gap AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS b FROM run),
per AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS front, max(z) AS z FROM gap JOIN doc USING (r) GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(x, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM doc LEFT JOIN per USING (r)
"""

_OP13 = """
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
g AS (SELECT lang, z, w[i : i + z - 1] AS g FROM (SELECT lang, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM w, range(1, 4) AS t(z) WHERE len(w) >= z)),
f AS (SELECT lang, z, g, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
total AS (SELECT lang, sum(a) AS n FROM f WHERE z = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE z > 1 AND a >= 10),
cut AS (SELECT c.lang, c.z, c.g, c.a, k, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score
  FROM (SELECT *, unnest(range(1, z)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 :]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner2 AS (SELECT lang, g, max(a) AS m FROM (SELECT lang, g[1 : 2] AS g, a FROM c WHERE z = 3 UNION ALL SELECT lang, g[2 : 3], a FROM c WHERE z = 3) GROUP BY lang, g),
kept AS (SELECT best.* FROM best LEFT JOIN inner2 USING (lang, g) WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {"op3_decontamination": _OP3, "op4_embedding_dedup": _OP4, "op5_near_dedup": _OP5, "op10_chat_format": _OP10, "op11_prefix_trie": _OP11, "op12_suffix_dedup": _OP12, "op13_collocations": _OP13}
