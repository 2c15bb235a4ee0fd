"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from .secrets import KINDS, SCOPE


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR_DUPS = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
one AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
items AS (SELECT rep, n, unnest(s) AS x FROM one),
pairs AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
copies AS (SELECT o.rep AS a, s.doc_id AS b FROM sets s JOIN one o ON list_sort(s.s) = o.s WHERE s.doc_id <> o.rep),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT a, b FROM copies UNION SELECT b, a FROM copies),
reach(doc_id, x) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.x = e.a)
SELECT r.doc_id, any_value(z.n) AS n_shingles, min(r.x) AS component_id, r.doc_id = min(r.x) AS kept FROM reach r JOIN sizes z USING (doc_id) GROUP BY r.doc_id"""

REPEATED = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, greatest(octet_length(b) - 48, 1))) AS i FROM d)),
firsts AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
dup AS (SELECT w.doc_id, w.i FROM w JOIN firsts f USING (s) WHERE f.m < w.doc_id),
marks AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM dup),
islands AS (SELECT doc_id, min(i) AS lo, max(i) + 49 AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marks) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS a, lo - 1 AS z FROM islands UNION ALL SELECT d.doc_id, coalesce(max(i.hi), 0) + 1, octet_length(any_value(d.b)) FROM d LEFT JOIN islands i USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT g.doc_id, string_agg(hex(array_slice(d.b, g.a, g.z)), '' ORDER BY g.a) AS h FROM gaps g JOIN d USING (doc_id) WHERE g.a <= g.z GROUP BY 1),
gone AS (SELECT doc_id, sum(hi - lo + 1) AS n, count(*) AS k FROM islands GROUP BY 1)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, coalesce(g.k, 0) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM d LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


def _kind(no: int) -> str:
    k, rx = KINDS[no], _q(KINDS[no].pattern.replace("\\x20", " "))
    value = f"regexp_extract_all(t, {rx}, {k.value_group})"
    must = "".join(f" AND regexp_matches(ms[i], {_q(m)})" for m in k.needs)
    return f"""k{no}_m AS (SELECT doc_id, regexp_extract_all(t, {rx}) AS ms, {value} AS vs, string_split_regex(t, {rx}) AS gs FROM d WHERE regexp_matches(t, {rx})),
k{no}_i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM k{no}_m),
k{no} AS (SELECT doc_id, {no} AS kind, {_q(k.name)} AS name, {_q(k.part)} AS part, {k.weak} AS weak, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS lo, length(ms[i]) AS n FROM k{no}_i WHERE length(vs[i]) >= {k.value_least}{must})"""


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
{", ".join(_kind(i) for i in range(len(KINDS)))},
parts AS ({" UNION ALL ".join(f"SELECT doc_id, kind, name, part, weak, lo, lo + n AS hi FROM k{i}" for i in range(len(KINDS)))}),
near AS (SELECT a.doc_id, a.kind, a.lo, a.hi, a.part, count(DISTINCT b.part) FILTER (b.part = 'key') AS has_key, count(DISTINCT b.part) FILTER (b.part = 'id') AS has_id FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND greatest(b.lo - a.hi, a.lo - b.hi) <= {SCOPE} WHERE a.weak GROUP BY ALL),
linked AS (SELECT doc_id, kind, lo, hi FROM near WHERE CASE part WHEN 'id' THEN has_key > 0 WHEN 'key' THEN has_id > 0 ELSE has_key > 0 AND has_id > 0 END),
shown AS (SELECT p.doc_id, p.kind, p.name, p.weak, p.lo, p.hi FROM parts p WHERE NOT p.weak UNION ALL SELECT DISTINCT p.doc_id, p.kind, p.name, p.weak, p.lo, p.hi FROM parts p JOIN linked l ON p.doc_id = l.doc_id AND p.kind = l.kind AND p.lo = l.lo AND p.hi = l.hi),
per AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, coalesce(string_agg(name || ':' || lo || ':' || hi, ',' ORDER BY lo, kind) FILTER (NOT weak), '') AS base, string_agg(name || ':' || lo || ':' || hi, ',' ORDER BY lo, kind) AS spans FROM shown GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (doc_id)"""

ORACLE_SQL = {"op1_near_dups": NEAR_DUPS, "op9_repeated_substrings": REPEATED, "op10_secret_scan": SECRETS}
