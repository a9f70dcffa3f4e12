"""DuckDB twins of the opN_ queries that SQL can express, in their plainest form."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AZ = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_AZ}, {_WORD}) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
k AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(g, chr(10)))) END AS class_id FROM s),
u AS (SELECT s.doc_id, unnest(g) AS t FROM s JOIN k ON s.doc_id = k.doc_id WHERE k.doc_id = k.class_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN k a ON x = a.doc_id JOIN k b ON y = b.doc_id WHERE 100 * o >= 75 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS root FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, coalesce(root, class_id) AS component_id, class_id FROM k LEFT JOIN c ON class_id = x
"""

_SIZE = f"CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT)"

OP3 = f"""
WITH d AS (SELECT doc_id, source, {_SIZE} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17') AS dice FROM documents),
b AS (SELECT *, CASE WHEN size < 8 THEN size ELSE (len(bin(size)) - 1) * 8 + CAST(floor(size / pow(2.0, len(bin(size)) - 4)) AS BIGINT) % 8 END AS lev, CAST('0x' || substr(dice, 1, 2) AS BIGINT) % 64 AS salt FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lev, salt, size, dice, doc_id NULLS FIRST) AS j FROM b),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS wt FROM d GROUP BY 1),
u AS (SELECT *, 3 * source_size AS cap, 3 * source_size / CAST(wt AS DOUBLE) AS ratio FROM t),
v AS (SELECT *, row_number() OVER o AS k, sum(cap) OVER o - cap AS capped, sum(wt) OVER o - wt AS spent FROM u WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, CAST(sum(source_size) OVER () - capped AS DOUBLE) / CAST(sum(wt) OVER () - spent AS DOUBLE) AS lam FROM v),
y AS (SELECT *, min(CASE WHEN ratio >= lam THEN k END) OVER () AS first FROM x),
z AS (SELECT *, max(CASE WHEN k = first THEN lam END) OVER () AS level FROM y),
g AS (SELECT source, source_size, CASE WHEN k >= first AND level * wt < cap THEN level * wt ELSE CAST(cap AS DOUBLE) END AS target, CAST('0x' || substr(md5(coalesce('=' || source, '~') || '#17'), 1, 7) AS BIGINT) * 4 AS off FROM z),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 1073741824.0::DOUBLE + 0.5) AS HUGEINT) ELSE 0 END AS step FROM g),
c AS (SELECT doc_id, size, source_size, target, CAST((off + j::HUGEINT * step) // 1073741824 - (off + (j - 1)::HUGEINT * step) // 1073741824 AS BIGINT) AS copies FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, copies * size AS taken, copies FROM c
"""

_W4 = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP4 = f"""
WITH i AS (SELECT item_id, regexp_extract_all({_AZ}, {_W4}) AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda k: array_to_string(ws[k:k + m - 1], ' '))) AS w FROM (SELECT *, least(len(ws), 10) AS m FROM i) WHERE m > 0),
d AS (SELECT doc_id, regexp_extract_all({_AZ}, {_W4}) AS ws FROM documents),
dw AS (SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS k, unnest(list_transform(range(1, len(ws) - m + 2), lambda k: array_to_string(ws[k:k + m - 1], ' '))) AS w FROM d, (SELECT DISTINCT m FROM iw) WHERE len(ws) >= m),
h AS (SELECT doc_id, dw.m, k, item_id FROM dw JOIN iw ON dw.w = iw.w AND dw.m = iw.m),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 49)) AS k, h FROM d WHERE n >= 50),
v AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM w),
c AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS first FROM v) WHERE doc_id > first),
r AS (SELECT doc_id, k, coalesce(max(k) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 < k, true) AS new FROM c),
g AS (SELECT doc_id, k, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM r),
s AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM g GROUP BY doc_id, run),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM s),
q AS (SELECT t.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept FROM t JOIN d ON t.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN q ON d.doc_id = q.doc_id
"""

OP10 = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS k, unnest(list_transform(range(1, len(ws) - 6), lambda k: array_to_string(ws[k:k + 7], ' '))) AS s FROM w WHERE len(ws) >= 8),
y AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS n FROM x) WHERE n > 1),
z AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + 8)) AS pos FROM y) GROUP BY 1),
f AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {_WORD})) AS ls, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_again, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN z ON w.doc_id = z.doc_id),
q AS (SELECT * EXCLUDE (ls, n_again), CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_symbols / greatest(n_words, 1)::DOUBLE AS a, (len(ls) - len(list_distinct(ls))) / greatest(len(ls), 1)::DOUBLE AS b, word_chars / greatest(n_words, 1)::DOUBLE AS c, n_again / greatest(n_words, 1)::DOUBLE AS d, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
t AS (SELECT lang, source, quantile_disc(a, 0.25) AS a1, quantile_disc(a, 0.75) AS a3, quantile_disc(b, 0.25) AS b1, quantile_disc(b, 0.75) AS b3, quantile_disc(c, 0.25) AS c1, quantile_disc(c, 0.75) AS c3, quantile_disc(d, 0.25) AS d1, quantile_disc(d, 0.75) AS d3 FROM q WHERE NOT base_failed GROUP BY 1, 2),
g AS (SELECT lang, quantile_disc(d, 0.25) AS g1, quantile_disc(d, 0.75) AS g3 FROM q WHERE NOT base_failed GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(a <= a3 + greatest(0.25, 3 * (a3 - a1)), true) AND coalesce(b <= b3 + greatest(0.5, 3 * (b3 - b1)), true) AND coalesce(c BETWEEN c1 - greatest(2, 3 * (c3 - c1)) AND c3 + greatest(3, 3 * (c3 - c1)), true) AND coalesce(d <= least(d3 + greatest(0.2, 3 * (d3 - d1)), g3 + greatest(0.2, 3 * (g3 - g1))), true) AS kept
FROM q LEFT JOIN t ON q.lang IS NOT DISTINCT FROM t.lang AND q.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON q.lang IS NOT DISTINCT FROM g.lang
"""

#: crc32 of the decimal doc_id, by the table of the reflected polynomial.
CRC = """
crc_t AS (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN crc_t)
"""


def _op11(rows_per_file: int = 2000) -> str:
    names, cells = ("date", "length", "lang", "source"), 8
    coords = ", ".join(f"CAST({cells} * (rank() OVER (ORDER BY {c} NULLS FIRST) - 1) // count(*) OVER () AS BIGINT) AS {c[0]}{c[1]}" for c in names)
    short = [c[:2] for c in names]
    z = " + ".join(f"(({c} >> {b} & 1) << {b * 4 + 3 - i})" for b in range(3) for i, c in enumerate(short))
    ends = ", ".join(f"min({c}) AS {c}0, max({c}) AS {c}1" for c in short)
    near = lambda c, lo, hi: f"{c} BETWEEN {lo} - {int(c in ('da', 'le'))} AND {hi} + {int(c in ('da', 'le'))}"
    meets = " AND ".join(near(c, f"{c}0", f"{c}1") for c in short)
    inside = " AND ".join(near(f"{c}", f"p.{c}", f"p.{c}").replace(c, f"q.{c}", 1) for c in short)
    bounds = " || ',' || ".join(f"{c}{e}" for c in ("so", "la", "le", "da") for e in (0, 1))
    return f"""
WITH {CRC},
d AS (SELECT doc_id, crc % 365 AS date, coalesce(strlen(text), -1) AS length, lang, source FROM documents LEFT JOIN crc USING (doc_id)),
c AS (SELECT doc_id, {coords} FROM d),
y AS (SELECT *, {z} AS z FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM y),
p AS (SELECT *, position // {rows_per_file} AS file FROM o),
f AS (SELECT file, {ends} FROM p GROUP BY 1),
u AS (SELECT DISTINCT z, {", ".join(short)} FROM p),
g AS (SELECT DISTINCT z, file, {", ".join(short)} FROM p),
t AS (SELECT z, count(*) AS files_touched FROM u JOIN f ON {meets} GROUP BY 1),
m AS (SELECT p.z, count(DISTINCT q.file) AS files_matching FROM u p JOIN g q ON {inside} GROUP BY 1)
SELECT doc_id, z, position, file, files_touched, files_matching, {bounds} AS file_bounds FROM p JOIN f USING (file) JOIN t USING (z) JOIN m USING (z)
"""


OP11 = _op11()


def _op12(k: int = 8, rounds: int = 10) -> str:
    held = "greatest(least(floor(1024 * CAST(e AS DOUBLE)), 134217728), -134217728)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, any_value(v.x) AS x, min(CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) * {k} + k) AS best FROM v CROSS JOIN c{r} c GROUP BY rid)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT best % {k} AS k, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL)")
            steps.append(f"n{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY k)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n ON c.k = n.k)")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST({held} AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('3:' || vec_id), x LIMIT {k}),
{", ".join(steps)},
r AS (SELECT vec_id, CAST(best % {k} AS INT) AS cluster, CAST(best // {k} AS BIGINT) AS distance FROM a{rounds} JOIN v USING (rid))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM r JOIN c{rounds} c ON r.cluster = c.k
"""


OP12 = _op12()


def _discounts(name: str, table: str, count: str) -> str:
    """Modified Kneser-Ney discounts d1, d2, d3 from counts of counts; fixed ones where a count is missing or a discount is out of range."""
    n = ", ".join(f"CAST(count(*) FILTER (WHERE {count} = {k}) AS DOUBLE) AS k{k}" for k in (1, 2, 3, 4))
    y = "k1 / (k1 + 2 * k2)"
    one = lambda k, fixed: f"CASE WHEN k1 * k2 * k3 * k4 > 0 AND {k} - {k + 1} * ({y}) * k{k + 1} / k{k} > 0 AND {k} - {k + 1} * ({y}) * k{k + 1} / k{k} <= {k} THEN {k} - {k + 1} * ({y}) * k{k + 1} / k{k} ELSE {fixed}::DOUBLE END AS d{k}"
    return f"{name} AS (SELECT *, {one(1, 0.5)}, {one(2, 1.0)}, {one(3, 1.5)} FROM (SELECT {n} FROM {table}))"


_OFF = lambda c, d: f"CASE WHEN {c} >= 3 THEN {d}.d3 WHEN {c} = 2 THEN {d}.d2 WHEN {c} = 1 THEN {d}.d1 ELSE 0 END"

OP13 = f"""
WITH {CRC},
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(crc % 10 = 0, false) AS held_out, list_append(regexp_extract_all({_AZ}, {_WORD}), ' </s>') AS ws FROM documents LEFT JOIN crc USING (doc_id)),
t AS MATERIALIZED (SELECT rid, held_out, unnest(list_prepend(' <s>', ws[1:len(ws) - 1])) AS a, unnest(ws) AS w FROM d),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
p AS MATERIALIZED (SELECT a, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1, 2),
l AS MATERIALIZED (SELECT w, count(*) AS k FROM p GROUP BY 1),
n AS (SELECT coalesce(sum(c), 0)::DOUBLE AS n, count(*) AS v FROM c),
{_discounts("e", "p", "c")},
{_discounts("f", "l", "k")},
g AS (SELECT sum(k)::DOUBLE AS kinds, sum({_OFF("k", "f")}) / sum(k)::DOUBLE AS spare FROM l CROSS JOIN f),
s AS MATERIALIZED (SELECT a, sum(c)::DOUBLE AS den, sum({_OFF("c", "e")}) AS spare FROM p CROSS JOIN e GROUP BY 1),
q AS (SELECT t.rid, coalesce(c.c, 0) AS c, CASE WHEN g.kinds IS NULL THEN 1.0 / (n.v + 1) ELSE (coalesce(l.k, 0) - {_OFF("l.k", "f")}) / g.kinds + g.spare / (n.v + 1) END AS low,
  s.den, s.spare, coalesce(p.c, 0) - {_OFF("p.c", "e")} AS top, n.n, n.v
  FROM t LEFT JOIN c ON t.w = c.w LEFT JOIN l ON t.w = l.w LEFT JOIN s ON t.a = s.a LEFT JOIN p ON t.a = p.a AND t.w = p.w CROSS JOIN n CROSS JOIN e CROSS JOIN f CROSS JOIN g)
SELECT any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
  round(sum(log10((c + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 6) AS base_score, round(sum(log10(CASE WHEN den IS NULL THEN low ELSE top / den + spare / den * low END)), 6) AS score
FROM q JOIN d USING (rid) GROUP BY rid
"""
