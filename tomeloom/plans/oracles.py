"""The registered queries as DuckDB SQL, where SQL can express them.

Patterns come from ``patterns``; those with look-arounds are written out
without them, for what the corpus can hold.
"""

from __future__ import annotations

from .. import dims
from .. import patterns as p
from ..operators.review import CUT_MARK, INSTRUCTION, PROMPT_CHARS
from .corpus import KEYED, LABELLED, filings_sql, pieces


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spans_sql(name: str, source: str, keys: str, text: str, pattern: str) -> str:
    """CTEs that give keys, i, hit, start (from 0) of every match of the pattern."""
    rx = q(pattern)
    return f"""{name}_m AS (SELECT {keys}, regexp_extract_all({text}, {rx}) AS ms, string_split_regex({text}, {rx}) AS gs FROM {source}),
{name}_i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {name}_m),
{name} AS (SELECT {keys}, i, ms[i] AS hit,
 CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM {name}_i)"""


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q('^' + p.ANY_SPACE + '+')}, ''), {q(p.ANY_SPACE + '+$')}, '')"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


FILINGS = f"filings AS ({filings_sql()})"
VALID = "(" + ", ".join(q(n) for n in dims.ITEM_NUMBERS) + ")"
PART = "coalesce((SELECT part FROM (VALUES " + values((n, part) for n, part, _ in dims.ITEMS) + ") v(n, part) WHERE n = {0}), 0)"
PARTS = "parts(item_number, part) AS (VALUES " + values((n, part) for n, part, _ in dims.ITEMS) + ")"
HEADINGS = f"""{FILINGS}, {spans_sql('hs', 'filings', 'filing_id', 'raw_text', p.HEADING)},
headings AS (SELECT filing_id, start, start + length(hit) AS "end", upper(regexp_extract(hit, {q(p.HEADING)}, 1)) AS item_number, regexp_extract(hit, {q(p.HEADING)}, 2) AS title FROM hs
 WHERE upper(regexp_extract(hit, {q(p.HEADING)}, 1)) IN {VALID})"""
ROOMS = f"""{HEADINGS},
rooms AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY filing_id ORDER BY start) - start, {dims.FAR}) AS room FROM headings),
picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filing_id, item_number ORDER BY room DESC, start DESC) AS n FROM rooms) WHERE n = 1)"""


def sliced(name: str, picks: str, title: str) -> str:
    return f"""{name}_s AS (SELECT filing_id, start, item_number, {title} AS item_title, row_number() OVER (PARTITION BY filing_id ORDER BY start) - 1 AS ord, lead(start) OVER (PARTITION BY filing_id ORDER BY start) AS nxt FROM {picks}),
{name}_b AS (SELECT s.filing_id, s.ord, s.item_number, s.item_title, {strip('substring(f.raw_text, s.start + 1, coalesce(s.nxt, length(f.raw_text)) - s.start)')} AS content_text FROM {name}_s s JOIN filings f USING (filing_id)),
{name} AS (SELECT b.filing_id, b.ord, coalesce(p.part, 0) AS part, b.item_number, substring(b.item_title, 1, 120) AS item_title, b.content_text FROM {name}_b b LEFT JOIN parts p USING (item_number) WHERE length(b.content_text) >= {dims.SHORTEST_SECTION})"""


STRIPPED_TITLE = strip(f"regexp_replace({strip('title')}, '\\.+$', '')")
SECTIONS = f"{ROOMS}, {PARTS}, {sliced('sections', 'picks', STRIPPED_TITLE)}"

_TITLE_MATCHES = " UNION ALL ".join(f"SELECT filing_id, start, hit, {no} AS no, {q(item)} AS item_number FROM t{no}" for no, (item, _) in enumerate(p.TITLE_PATTERNS))
TITLES_CORE = ",\n".join(spans_sql(f"t{no}", "filings", "filing_id", "raw_text", rx) for no, (_, rx) in enumerate(p.TITLE_PATTERNS)) + f""",
title_all AS ({_TITLE_MATCHES}),
title_last AS (SELECT filing_id, item_number, start, {strip('hit')} AS title FROM (SELECT *, row_number() OVER (PARTITION BY filing_id, item_number ORDER BY start DESC, no DESC) AS n FROM title_all) WHERE n = 1),
{sliced('titles', 'title_last', 'title')}"""
TITLES = f"{FILINGS}, {PARTS}, {TITLES_CORE}"
INDEX_CORE = f"""regions AS (SELECT filing_id, array_to_string(string_split_regex(raw_text, {q(p.INDEX_HEADER)})[2:], '') AS region FROM filings WHERE regexp_matches(raw_text, {q(p.INDEX_HEADER)})),
{spans_sql('ix', 'regions', 'filing_id', 'region', p.INDEX_LINE)},
ix_rows AS (SELECT filing_id, start, upper(regexp_extract(hit, {q(p.INDEX_LINE)}, 1)) AS item_number, list_filter(string_split_regex({strip(f"regexp_extract(hit, {q(p.INDEX_LINE)}, 2)")}, {q(p.INDEX_SPLIT)}), lambda x: {strip('x')} <> '') AS xs FROM ix),
ix_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filing_id, item_number ORDER BY start) AS n FROM ix_rows) WHERE n = 1),
ix_parts AS (SELECT filing_id, item_number, start, CASE WHEN len(xs) > 1 THEN {strip("array_to_string(xs[1:len(xs) - 1], ' ')")} ELSE coalesce(xs[1], '') END AS title, CASE WHEN len(xs) > 1 THEN {strip('xs[len(xs)]')} ELSE '' END AS ref FROM ix_first),
indexed AS (SELECT i.filing_id, row_number() OVER (PARTITION BY i.filing_id ORDER BY start) - 1 AS ord, coalesce(p.part, 0) AS part, i.item_number, substring(title, 1, 120) AS item_title, {strip("'[Cross-reference TOC] ' || title || ' (' || ref || ')'")} AS content_text,
 CASE WHEN ref = '' THEN 'extracted' WHEN contains(lower(ref), 'not applicable') OR lower(ref) IN ('none', 'n/a') THEN 'not_applicable' WHEN regexp_matches(lower(ref), {q(p.INDEX_FOOTNOTE)}) THEN 'incorporated_by_reference' ELSE 'extracted' END AS status_hint
 FROM ix_parts i LEFT JOIN parts p USING (item_number))"""
INDEX = f"{FILINGS}, {PARTS}, {INDEX_CORE}"
STRATEGY = f"""{SECTIONS}, {TITLES_CORE}, {INDEX_CORE},
counted AS (SELECT filing_id, 'heading' AS source, 1 AS prio, count(*) AS n FROM sections GROUP BY 1 UNION ALL SELECT filing_id, 'index', 2, count(*) FROM indexed GROUP BY 1 UNION ALL SELECT filing_id, 'title', 3, count(*) FROM titles GROUP BY 1),
ranked AS (SELECT *, CASE WHEN source = 'index' AND n >= {dims.WHOLE_FILING} THEN 0 WHEN source = 'heading' AND n >= {dims.WHOLE_FILING} THEN 1 ELSE 2 END AS r FROM counted),
strategy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY r, CASE WHEN r = 2 THEN -n ELSE 0 END, prio) AS k FROM ranked) WHERE k = 1)"""
SUSPECT = """starts AS (SELECT filing_id, item_number, substring(content_text, 1, 500) AS st FROM {0}),
alike AS (SELECT filing_id, bool_or(a) AS alike FROM (SELECT filing_id, st, min(item_number) <> max(item_number) AS a FROM starts WHERE st <> '' GROUP BY 1, 2) GROUP BY 1),
suspects AS (SELECT s.filing_id, count(*) AS n, count(*) < 8 OR coalesce(any_value(a.alike), false) AS suspect FROM {0} s LEFT JOIN alike a USING (filing_id) GROUP BY 1)"""

_W = "[\\p{L}\\p{N}_]"
NA_TAIL = f"(?is)^[A-Za-z][\\p{{L}}\\p{{N}}_\\s{p.NBSP},\\-'’&/().]{{0,200}}?(?:not{p.ANY_SPACE}+applicable|none)\\.?{p.ANY_SPACE}*$"
_BODY = strip(f"regexp_replace(replace(content_text, {q(p.NBSP)}, ' '), {q(p.ITEM_PREFIX)}, '')")
_IBR = q(p.BY_REFERENCE)


def statuses(name: str, source: str) -> str:
    """CTEs that give the source's sections their status; a hint goes first."""
    return f"""{name}_b AS (SELECT *, {_BODY} AS body, regexp_extract_all(content_text, {_IBR}) AS refs FROM {source}),
{name} AS (SELECT filing_id, ord, part, item_number, item_title, content_text, CASE
 WHEN status_hint <> '' THEN status_hint
 WHEN length(body) < 300 AND regexp_matches(body, {q(p.RESERVED)}) THEN 'reserved'
 WHEN length(body) < 250 AND (regexp_matches(body, {q(p.NOT_APPLICABLE)}) OR regexp_matches(body, {q(NA_TAIL)})) THEN 'not_applicable'
 WHEN len(refs) > 0 AND regexp_matches(content_text, {q(p.REMAINING)}) THEN 'partial'
 WHEN len(refs) > 0 AND (length(content_text) < 400 OR list_sum(list_transform(refs, lambda x: length(x))) > length(content_text) * 0.30) THEN 'incorporated_by_reference'
 WHEN len(refs) > 0 THEN 'partial'
 WHEN regexp_matches(content_text, {q(p.SEE_PROXY)}) AND length(content_text) < 600 THEN 'incorporated_by_reference'
 ELSE 'extracted' END AS status FROM {name}_b)"""


STATUS = f"{SECTIONS}, hinted AS (SELECT *, NULL AS status_hint FROM sections), {statuses('classified', 'hinted')}"
COVER = f"""covers AS (SELECT filing_id, regexp_extract(split_part(raw_text, 'DOCUMENTS INCORPORATED BY REFERENCE', 2), {q('(?is)(19[89][0-9]|20[0-9]{2})' + p.ANY_SPACE + '+(?:annual' + p.ANY_SPACE + '+meeting|proxy' + p.ANY_SPACE + '+statement|definitive' + p.ANY_SPACE + '+proxy)')}, 1) AS y FROM filings WHERE contains(raw_text, 'DOCUMENTS INCORPORATED BY REFERENCE')),
cover AS (SELECT filing_id, CAST(y AS BIGINT) AS expected_year FROM covers WHERE y <> '')"""
_DUE = " UNION ALL ".join(
    f"SELECT filing_id, {part} AS part, {q(n)} AS item_number FROM filings" + (f" WHERE {on[n][1]} >= DATE {q(on[n][0])}" if n in on else "")
    for on in [{n: (d, o) for n, d, o in dims.INTRODUCED}]
    for n, part, _ in dims.ITEMS
)


def _library(kind: str) -> str:
    out, holds = [], KEYED if kind == "keyed" else LABELLED
    for no, (n, part, title) in enumerate(dims.ITEMS):
        body = f"{q(f'Item {n}.  {title}  ')} || {pieces(holds, no)} || CASE WHEN (doc_id + {no}) % 6 = 0 THEN ' Item 99. Bleeds in.' ELSE '' END"
        key = f"part_{('i', 'ii', 'iii', 'iv')[part - 1]}_item_{n.lower()}" if kind == "keyed" else f"Item {n}"
        on = f"(doc_id + {no}) % 3 = 0" if kind == "keyed" else f"(doc_id + {no}) % 4 <= 1"
        out.append(f"SELECT doc_id AS filing_id, {no} AS ord, {part} AS part, {q(n)} AS item_number, {q(key)} AS key, {body} AS text FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents WHERE doc_id IS NOT NULL) WHERE {on}")
    return " UNION ALL ".join(out)


_RSTRIP = lambda x: f"regexp_replace({x}, {q(p.ANY_SPACE + '+$')}, '')"
_FIRST = f"regexp_extract_all(x, {q(p.BLEED)})"
TRIM = f"""CASE WHEN len(regexp_extract_all(x, {q(p.BLEED)})) >= 2 THEN {_RSTRIP(f"substring(x, 1, length(string_split_regex(x, {q(p.BLEED)})[1]) + length({_FIRST}[1]) + length(string_split_regex(x, {q(p.BLEED)})[2]))")} ELSE x END"""
LIB = f"""keyed AS (SELECT *, {strip('text')} AS x FROM ({_library('keyed')})), labelled AS (SELECT *, {strip('text')} AS x FROM ({_library('labelled')})),
lib AS (SELECT filing_id, part, item_number, {TRIM} AS content_text FROM keyed WHERE x <> '' UNION ALL SELECT filing_id, part, item_number, {TRIM} FROM labelled l WHERE x <> '' AND NOT EXISTS (SELECT 1 FROM keyed k WHERE k.filing_id = l.filing_id AND k.item_number = l.item_number))"""
ABS = f"(contains(lower(substring(raw_text, 1, 20000)), 'regulation ab') OR regexp_matches(lower(substring(raw_text, 1, 20000)), {q(p.REGULATION_AB)}))"

COMPANY = """raw AS (SELECT o_custkey, ['Revenues', 'NetIncomeLoss', 'Assets', 'SalesRevenueNet'][o_orderkey % 4 + 1] AS concept, o_orderkey, o_totalprice AS val, CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE 'acc-' || o_custkey END AS accn, year(o_orderdate) AS fy, CASE WHEN o_orderkey % 2 = 0 THEN 'FY' ELSE 'Q1' END AS fp FROM orders),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, concept ORDER BY o_orderkey) - 1 AS fact_pos, dense_rank() OVER (PARTITION BY o_custkey ORDER BY concept) - 1 AS concept_pos FROM raw),
facts AS (SELECT o_custkey AS filing_id, concept, 'USD' AS unit, concept_pos, fact_pos, fy, fp, val FROM placed WHERE accn = 'acc-' || o_custkey)"""
PICK = """grp(concept_group, preference, concept) AS (VALUES """ + values((g, no, n) for g, names in dims.CONCEPT_GROUPS for no, n in enumerate(names)) + """),
picked AS (SELECT * FROM (SELECT f.*, g.concept_group, row_number() OVER (PARTITION BY f.filing_id, g.concept_group ORDER BY g.preference, CASE WHEN fp = 'FY' AND fy = 1992 + f.filing_id % 7 THEN 0 WHEN fp = 'FY' THEN 1 ELSE 2 END, fact_pos) AS k FROM facts f JOIN grp g USING (concept)) WHERE k = 1)"""


def _forms(v: str, text: str) -> str:
    out = [f"WHEN contains({text}, format('{{:,}}', CAST(round_even(abs({v}), 0) AS BIGINT))) THEN 'exact'"]
    for scale, form in dims.SCALES:
        out += [f"WHEN abs({v}) / {scale}.0 >= 0.1 AND contains({text}, format('{{:,.{d}f}}', abs({v}) / {scale}.0)) THEN {q(form)}" for d in dims.DECIMALS]
    return f"CASE WHEN {v} = 0 THEN NULL {' '.join(out)} END"


_ORDER_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN 'total of $' || format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) WHEN 1 THEN 'about $' || format('{:,.1f}', o_totalprice / 1000.0) || ' thousand'
 WHEN 2 THEN 'some $' || format('{:,.2f}', o_totalprice / 1000000.0) || ' million' WHEN 3 THEN 'no number here' ELSE '$' || format('{:,.0f}', o_totalprice / 1000.0) || ' K' END"""
_STATUSES = "[" + ", ".join(q(s) for s in dims.STATUSES) + "]"
VOTES = f"""named AS (SELECT doc_id AS filing_id, pos AS provider_pos, doc_id + pos AS k, {_STATUSES}[(doc_id * 7 + pos * (doc_id % 3)) % 6 + 1] AS name FROM labels, (VALUES (0), (1), (2)) v(pos)),
cast_votes AS (SELECT filing_id, provider_pos, CASE WHEN k % 7 IN (2, 3, 4) THEN NULL ELSE name END AS value FROM named),
tops AS (SELECT filing_id, value, count(*) AS n, min(provider_pos) AS f FROM cast_votes WHERE value IS NOT NULL GROUP BY 1, 2),
per AS (SELECT filing_id, sum(n) AS n_votes, max(n) AS n_top, arg_min(value, f) AS earliest, arg_min(n, f) AS earliest_n, arg_max(value, n) AS most FROM tops GROUP BY 1),
ties AS (SELECT t.filing_id, count(*) > 1 AS tie FROM tops t JOIN per p ON t.filing_id = p.filing_id AND t.n = p.n_top GROUP BY 1)"""


def _items(name: str, shift: int) -> str:
    rows = " UNION ALL ".join(
        f"SELECT doc_id AS filing_id, {no} AS ord, {q(n if no % 2 else n.lower())} AS item_number, {_STATUSES}[(doc_id + {no} + CASE WHEN doc_id % 4 = 0 THEN {shift} ELSE 0 END) % 6 + 1] AS status FROM labels WHERE (doc_id * 3 + {no + shift}) % 5 <> 0"
        for no, (n, _, _) in enumerate(dims.ITEMS)
    )
    return f"{name} AS ({rows})"


SCORES = f"""{_items('got', 1)}, {_items('want', 0)},
g AS (SELECT filing_id, upper(item_number) AS item, arg_max(status, ord) AS last, list(DISTINCT status) AS ss, count(*) AS n FROM got GROUP BY 1, 2),
w AS (SELECT filing_id, upper(item_number) AS item, arg_max(status, ord) AS last, list(DISTINCT status) AS ss, count(*) AS n FROM want GROUP BY 1, 2),
j AS (SELECT coalesce(g.filing_id, w.filing_id) AS filing_id, coalesce(g.item, w.item) AS item, g.last AS gl, w.last AS wl, g.ss AS gs, w.ss AS ws, g.n AS gn, w.n AS wn FROM g FULL JOIN w ON g.filing_id = w.filing_id AND g.item = w.item),
scored AS (SELECT filing_id, coalesce(sum(gn), 0) AS items_actual, coalesce(sum(wn), 0) AS items_expected, count(*) FILTER (gl IS NOT NULL AND wl IS NOT NULL) AS tp, count(*) FILTER (wl IS NULL) AS fp, count(*) FILTER (gl IS NULL) AS fn,
 count(*) FILTER (gl = wl) AS status_correct, coalesce(sum(len(list_intersect(gs, ws))), 0) AS pairs_correct, coalesce(sum(len(ws)), 0) AS pairs_expected,
 coalesce(string_agg(item, ',' ORDER BY item) FILTER (wl IS NULL), '') AS fp_items, coalesce(string_agg(item, ',' ORDER BY item) FILTER (gl IS NULL), '') AS fn_items,
 coalesce(string_agg(item || ':' || wl || ':' || gl, ',' ORDER BY item || ':' || wl || ':' || gl) FILTER (gl <> wl), '') AS mismatches FROM j GROUP BY 1)"""
_HTML = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"

_NBSP = q(p.NBSP)
_MARK = lambda o: f"substring(body, {o + 1}, 120)"


def cursor(source: str, asked: str = "true") -> str:
    """CTEs that align the sections with a source along a cursor, for the filings asked for."""
    place = lambda o: f"position({_MARK(o)} IN substring({source}, cur.place + 1))"
    start = "CASE " + " ".join(f"WHEN length({_MARK(o)}) >= 40 AND {place(o)} > 0 THEN greatest({place(o)} - 1 - {o} - head, 0) + cur.place" for o in (0, 200, 500)) + " END"
    return f"""{SECTIONS}, bare AS (SELECT filing_id, ord, item_number, content_text, {strip(f"replace(content_text, {_NBSP}, ' ')")} AS t FROM sections),
cuts AS (SELECT *, position(chr(10) IN t) - 1 AS line, CASE WHEN position('  ' IN substring(t, 51)) > 0 THEN position('  ' IN substring(t, 51)) + 49 ELSE -1 END AS wide FROM bare),
bodies AS (SELECT *, CASE WHEN line > 0 AND line < 200 THEN {strip('substring(t, line + 2)')} WHEN wide > 0 AND wide < 200 THEN {strip('substring(t, wide + 3)')} ELSE t END AS body FROM cuts),
prep AS MATERIALIZED (SELECT filing_id, ord, item_number, content_text, body, CASE WHEN body = '' THEN 0 ELSE greatest(position(substring(body, 1, 40) IN content_text) - 1, 0) END AS head, row_number() OVER (PARTITION BY filing_id ORDER BY ord) AS k FROM bodies),
cur AS (SELECT filing_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM filings WHERE {asked}
 UNION ALL SELECT filing_id, k, CASE WHEN s IS NULL THEN place ELSE least(s + n, total) END, s, CASE WHEN s IS NOT NULL THEN least(s + n, total) END FROM (SELECT cur.filing_id, prep.k, cur.place, {start} AS s, length(content_text) AS n, length({source}) AS total FROM cur JOIN prep ON prep.filing_id = cur.filing_id AND prep.k = cur.k + 1 JOIN filings f ON f.filing_id = cur.filing_id)),
aligned AS (SELECT p.filing_id, p.item_number, CAST(p.ord AS BIGINT) AS ord, c.s AS start, c.e AS "end" FROM cur c JOIN prep p ON p.filing_id = c.filing_id AND p.k = c.k)"""


CURSOR = cursor("f.raw_text")
HTML = "('<html><body>' || replace(f.raw_text, chr(10), '<br>' || chr(10)) || '</body></html>')"
_REASON = f"""CASE WHEN status <> 'extracted' OR starts_with(content_text, '[Cross-reference TOC]') THEN false ELSE length(content_text) < 500 OR regexp_matches(content_text, {q(p.HINT_BY_REFERENCE)}) OR regexp_matches(content_text, {q(p.HINT_SEE_ITEM)}) OR regexp_matches(content_text, {q(p.REMAINING)}) END"""
REVIEWED = f"""{STATUS}, doubt AS (SELECT filing_id, item_number FROM classified WHERE {_REASON}),
said AS (SELECT filing_id, item_number, pos, k % 11 = 0 AS idle, {_STATUSES}[k % 6 + 1] AS value FROM (SELECT filing_id, item_number, pos, filing_id + length(item_number) * 5 + CASE WHEN filing_id % 2 = 0 THEN 0 ELSE pos END AS k FROM doubt, (VALUES (0), (1), (2)) v(pos) WHERE item_number IN ('1A', '7', '8', '10'))),
sums AS (SELECT filing_id, item_number, value, count(*) AS n FROM said WHERE NOT idle GROUP BY ALL),
won AS (SELECT filing_id, item_number, sum(n) AS n_votes, max(n) AS top, arg_max(value, n) AS most, count(*) FILTER (n = t) > 1 AS tie FROM (SELECT *, max(n) OVER (PARTITION BY filing_id, item_number) AS t FROM sums) GROUP BY 1, 2),
judged AS (SELECT d.*, coalesce(w.n_votes, 0) AS n_votes, coalesce(NOT tie AND top >= 0.51 * w.n_votes AND most <> 'extracted', false) AS changed, most, top FROM doubt d LEFT JOIN won w USING (filing_id, item_number))"""
_RATES = {
    "item_recall": "CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END",
    "item_precision": "CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END",
    "status_accuracy": "CASE WHEN tp = 0 THEN 0.0 ELSE CAST(status_correct AS DOUBLE) / tp END",
    "full_match_rate": "CASE WHEN pairs_expected = 0 THEN 0.0 ELSE CAST(pairs_correct AS DOUBLE) / pairs_expected END",
}
WITH_ERRORS = f"""{SCORES}, failed AS (SELECT doc_id AS filing_id, 'not labelled' AS error FROM documents WHERE doc_id % 17 = 3 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)),
told AS (SELECT coalesce(s.filing_id, f.filing_id) AS filing_id, {", ".join(f"coalesce({x}, 0) AS {n}" for n, x in _RATES.items())}, error FROM scored s FULL JOIN failed f ON f.filing_id = s.filing_id)"""

ORACLE_SQL: dict[str, str] = {
    "heading_spans": f'WITH {HEADINGS} SELECT filing_id, start, "end", item_number, title FROM headings',
    "best_heading_per_item": f"WITH {ROOMS} SELECT filing_id, item_number, start, CAST(room AS BIGINT) AS room FROM picks",
    "section_slices": f"WITH {SECTIONS} SELECT ord, CAST(part AS BIGINT) AS part, filing_id, item_number, item_title, content_text FROM sections",
    "title_sections": f"WITH {TITLES} SELECT ord, CAST(part AS BIGINT) AS part, filing_id, item_number, item_title, content_text FROM titles",
    "index_table_sections": f"WITH {INDEX} SELECT ord, CAST(part AS BIGINT) AS part, filing_id, item_number, item_title, content_text, status_hint FROM indexed",
    "segment_strategy": f"WITH {STRATEGY} SELECT filing_id, source, n FROM strategy",
    "coverage_suspect": f"WITH {SECTIONS}, {SUSPECT.format('sections')} SELECT filing_id, n, suspect FROM suspects",
    "library_sections_merge": f"""WITH {STRATEGY}, {LIB}, {SUSPECT.format('lib')},
patterned AS (SELECT s.filing_id, 'heading' AS source, s.part, s.item_number, s.content_text FROM sections s JOIN strategy t ON t.filing_id = s.filing_id AND t.source = 'heading' UNION ALL SELECT s.filing_id, 'index', s.part, s.item_number, s.content_text FROM indexed s JOIN strategy t ON t.filing_id = s.filing_id AND t.source = 'index' UNION ALL SELECT s.filing_id, 'title', s.part, s.item_number, s.content_text FROM titles s JOIN strategy t ON t.filing_id = s.filing_id AND t.source = 'title'),
chosen AS (SELECT f.filing_id, NOT {ABS} AND coalesce(u.suspect, true) AND coalesce(t.n, 0) > coalesce(u.n, 0) AS by_pattern FROM filings f LEFT JOIN suspects u USING (filing_id) LEFT JOIN strategy t USING (filing_id))
SELECT filing_id, 'lib' AS source, CAST(part AS BIGINT) AS part, item_number, length(content_text) AS n_chars FROM lib WHERE filing_id IN (SELECT filing_id FROM chosen WHERE NOT by_pattern) UNION ALL SELECT filing_id, source, CAST(part AS BIGINT), item_number, length(content_text) FROM patterned WHERE filing_id IN (SELECT filing_id FROM chosen WHERE by_pattern)""",
    "bleed_trim": f"WITH keyed AS (SELECT *, {strip('text')} AS x FROM ({_library('keyed')})) SELECT filing_id, key, {TRIM} AS content_text FROM keyed",
    "abs_filings": f"WITH {FILINGS} SELECT filing_id, CAST(0 AS BIGINT) AS part, 'abs' AS item_number, 'non_standard' AS status, false AS applicable_in_era FROM filings WHERE {ABS}",
    "status_by_item": f"WITH {STATUS} SELECT filing_id, item_number, status FROM classified",
    "status_distribution": f"WITH {STATUS} SELECT filing_id, status, count(*) AS n FROM classified GROUP BY 1, 2",
    "cover_reference": f"WITH {STATUS}, {COVER} SELECT c.filing_id, c.item_number, CASE WHEN v.filing_id IS NOT NULL AND c.status IN ('incorporated_by_reference', 'partial') THEN 'DEF 14A' END AS target_form, CASE WHEN c.status IN ('incorporated_by_reference', 'partial') THEN v.expected_year END AS expected_year FROM classified c LEFT JOIN cover v USING (filing_id)",
    "era_applicability": f"WITH {ROOMS}, {PARTS}, due AS ({_DUE}) SELECT p.filing_id, p.item_number, CAST(coalesce(t.part, 0) AS BIGINT) AS part, d.item_number IS NOT NULL AS applicable_in_era FROM picks p LEFT JOIN parts t USING (item_number) LEFT JOIN due d ON d.filing_id = p.filing_id AND d.item_number = p.item_number",
    "era_gaps": f"""WITH {ROOMS}, due AS ({_DUE}), miss AS (SELECT d.filing_id, string_agg(d.item_number, ',' ORDER BY d.item_number) AS s FROM due d ANTI JOIN picks p ON p.filing_id = d.filing_id AND p.item_number = d.item_number GROUP BY 1),
odd AS (SELECT p.filing_id, string_agg(p.item_number, ',' ORDER BY p.item_number) AS s FROM picks p ANTI JOIN due d ON p.filing_id = d.filing_id AND p.item_number = d.item_number GROUP BY 1)
SELECT f.filing_id, coalesce(m.s, '') AS missing, coalesce(o.s, '') AS unexpected FROM filings f LEFT JOIN miss m USING (filing_id) LEFT JOIN odd o USING (filing_id)""",
    "document_order": f"""WITH {FILINGS}, {COVER}, {LIB} SELECT filing_id, CAST(-1 AS BIGINT) AS ord, 'cover' AS item_number FROM cover UNION ALL SELECT filing_id, row_number() OVER (PARTITION BY filing_id ORDER BY part, CAST(regexp_extract(item_number, '^([0-9]+)', 1) AS INT), regexp_extract(item_number, '([A-Z]?)$', 1)) - 1, item_number FROM lib""",
    "align_exact": """WITH met AS (SELECT DISTINCT d.doc_id, b.item_id, d.text AS t, b.text AS x FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)),
places AS (SELECT *, unnest(range(1, length(t) - length(x) + 2)) AS i FROM met)
SELECT doc_id, item_id, CAST(i - 1 AS BIGINT) AS start FROM places WHERE substring(t, i, length(x)) = x""",
    "span_iou": """WITH s AS (SELECT doc_id, doc_id % 50 AS a0, doc_id % 50 + doc_id % 13 AS a1, doc_id % 37 AS b0, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 37 + doc_id % 17 - CASE WHEN doc_id % 19 = 0 THEN 30 ELSE 0 END END AS b1 FROM documents),
i AS (SELECT *, greatest(0, least(a1, b1) - greatest(a0, b0)) AS x FROM s), u AS (SELECT *, (a1 - a0) + (b1 - b0) - x AS w FROM i),
r AS (SELECT doc_id, CASE WHEN b1 IS NULL THEN 0.0 WHEN a1 < a0 OR b1 < b0 THEN 0.0 WHEN w = 0 THEN CASE WHEN a0 = b0 AND a1 = b1 THEN 1.0 ELSE 0.0 END ELSE CAST(x AS DOUBLE) / w END AS iou FROM u)
SELECT doc_id % 10 AS bucket, count(*) AS n, count(*) FILTER (iou > 0) AS overlapping, count(*) FILTER (iou = 1) AS equal, round(avg(CAST(iou AS DOUBLE)), 6) AS mean_iou FROM r GROUP BY 1""",
    "facts_unnest": f"WITH {COMPANY} SELECT filing_id, concept, unit, concept_pos, fact_pos, CAST(fy AS BIGINT) AS fy, fp, val FROM facts",
    "fiscal_pick": f"WITH {COMPANY}, {PICK} SELECT filing_id, concept_group, concept, CAST(fy AS BIGINT) AS fy, fp, val FROM picked",
    "value_in_text": f"WITH t AS (SELECT o_orderkey, o_totalprice AS v, {_ORDER_TEXT} AS text FROM orders) SELECT o_orderkey, {_forms('v', 'text')} AS match_form FROM t",
    "facts_report": f"""WITH {COMPANY}, {PICK}, tops AS (SELECT filing_id, count(*) AS n, max(val) AS top, arg_min(fy, (concept_pos, fact_pos)) AS ffy FROM facts GROUP BY 1),
secs AS (SELECT *, CASE WHEN filing_id % 3 = 0 THEN 'incorporated_by_reference' ELSE 'extracted' END AS status, 'Values of ' || format('{{:,}}', CAST(round_even(top, 0) AS BIGINT)) || ' were reported.' AS content FROM tops),
chk AS (SELECT p.filing_id, count(*) AS n_checks, count(*) FILTER ({_forms('p.val', 's.content')} IS NOT NULL) AS n_found FROM picked p JOIN secs s USING (filing_id) GROUP BY 1),
co AS (SELECT DISTINCT o_custkey AS filing_id FROM orders),
b AS (SELECT co.filing_id, co.filing_id % 9 <> 0 AND coalesce(s.n, 0) > 0 AS has, coalesce(s.n, 0) AS n, s.status, abs(s.ffy - (1992 + co.filing_id % 7)) > 1 AS apart, coalesce(k.n_checks, 0) AS nc, coalesce(k.n_found, 0) AS nf FROM co LEFT JOIN secs s USING (filing_id) LEFT JOIN chk k USING (filing_id)),
w AS (SELECT *, coalesce((status = 'extracted' AND n < 20) OR (status <> 'extracted' AND n > 50), false) AS odd FROM b)
SELECT filing_id, has AS has_xbrl_data, CASE WHEN has THEN n ELSE 0 END AS total_facts, NOT has OR NOT odd AS item_8_status_consistent, NOT has OR NOT coalesce(apart, false) AS period_aligned, CASE WHEN has THEN nc ELSE 0 END AS n_checks, CASE WHEN has THEN nf ELSE 0 END AS n_found,
 CAST(CASE WHEN NOT has THEN 1 ELSE CAST(odd AS INT) + CAST(coalesce(apart, false) AS INT) + CAST(status = 'extracted' AND nc > nf AS INT) END AS BIGINT) AS n_warnings FROM w""",
    "augment_trigger": f"""WITH {STATUS} SELECT filing_id, item_number, CASE WHEN status <> 'extracted' OR starts_with(content_text, '[Cross-reference TOC]') THEN NULL WHEN length(content_text) < 500 THEN 'short content (' || length(content_text) || ' chars); possible missed by-reference'
 WHEN regexp_matches(content_text, {q(p.HINT_BY_REFERENCE)}) THEN 'contains ''incorporated by reference'' phrase' WHEN regexp_matches(content_text, {q(p.HINT_SEE_ITEM)}) THEN 'contains ''see Item N'' within-document cross-reference'
 WHEN regexp_matches(content_text, {q(p.REMAINING)}) THEN 'contains ''remaining/additional information by this Item'' (partial signal)' END AS reason FROM classified""",
    "ballot_parse": f"WITH {VOTES} SELECT filing_id, CAST(provider_pos AS BIGINT) AS provider_pos, value FROM cast_votes",
    "vote_majority": f"""WITH {VOTES}, a AS (SELECT DISTINCT doc_id AS filing_id, CASE WHEN doc_id % 5 <> 0 THEN 'extracted' END AS fallback FROM labels), x AS (SELECT a.*, p.*, t.tie, p.n_votes IS NULL OR (t.tie AND fallback IS NOT NULL) AS back FROM a LEFT JOIN per p ON p.filing_id = a.filing_id LEFT JOIN ties t ON t.filing_id = a.filing_id)
SELECT filing_id, CASE WHEN back THEN fallback WHEN tie THEN earliest ELSE most END AS pick, CAST(CASE WHEN back THEN 0 WHEN tie THEN earliest_n ELSE n_top END AS BIGINT) AS n_top, CAST(coalesce(n_votes, 0) AS BIGINT) AS n_votes, back AS fallback_used FROM x""",
    "vote_override": f"""WITH {VOTES}, a AS (SELECT DISTINCT doc_id AS filing_id FROM labels), x AS (SELECT a.filing_id, p.n_votes IS NOT NULL AND NOT t.tie AND p.n_top >= 0.51 * p.n_votes AND p.most <> 'extracted' AS change, p.most FROM a LEFT JOIN per p USING (filing_id) LEFT JOIN ties t USING (filing_id))
SELECT filing_id, CASE WHEN coalesce(change, false) THEN most ELSE 'extracted' END AS status, 'extracted' AS old_status, coalesce(change, false) AS overridden FROM x""",
    "gold_scores": f"WITH {SCORES} SELECT filing_id, CAST(items_actual AS BIGINT) AS items_actual, CAST(items_expected AS BIGINT) AS items_expected, tp, fp, fn, status_correct, CAST(pairs_correct AS BIGINT) AS pairs_correct, CAST(pairs_expected AS BIGINT) AS pairs_expected, fp_items, fn_items, mismatches FROM scored",
    "gold_means": f"WITH {SCORES} SELECT count(*) AS filings, round(avg(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END), 6) AS item_recall, round(avg(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END), 6) AS item_precision, round(avg(CASE WHEN tp = 0 THEN 0.0 ELSE CAST(status_correct AS DOUBLE) / tp END), 6) AS status_accuracy, round(avg(CASE WHEN pairs_expected = 0 THEN 0.0 ELSE CAST(pairs_correct AS DOUBLE) / pairs_expected END), 6) AS full_match_rate FROM scored",
    "constraint_violations": f"""WITH {_items('got', 1)}, per AS (SELECT filing_id, count(*) AS n, bool_or(item_number = '1C') AS h1c, bool_or(item_number = '9C' OR item_number = '9c' AND false) AS h9c, max(status) FILTER (item_number = '10') AS s10, max(status) FILTER (item_number = '7a') AS s7al, max(status) FILTER (item_number = '7A') AS s7a FROM got GROUP BY 1), f AS (SELECT DISTINCT doc_id AS filing_id FROM labels)
SELECT f.filing_id, concat_ws('; ', CASE WHEN f.filing_id % 2 = 0 AND coalesce(n, 0) < 19 THEN 'min_items=19 but got ' || coalesce(n, 0) END, CASE WHEN f.filing_id % 3 = 0 AND coalesce(n, 0) > 17 THEN 'max_items=17 but got ' || n END, CASE WHEN h1c THEN 'unexpected item 1C present (era boundary)' END, CASE WHEN h9c THEN 'unexpected item 9C present (era boundary)' END,
 CASE WHEN s10 IS NULL THEN 'required item 10 missing' WHEN s10 NOT IN ('extracted', 'partial') THEN 'item 10 has status ''' || s10 || ''', expected one of [''extracted'', ''partial'']' END, CASE WHEN s7a IS NULL THEN 'required item 7A missing' WHEN s7a <> 'reserved' THEN 'item 7A has status ''' || s7a || ''', expected one of [''reserved'']' END,
 CASE WHEN f.filing_id % 10 = 0 THEN 'is_abs=false, expected true' END) AS violations FROM f LEFT JOIN per USING (filing_id)""",
    "token_bucket": """WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) AS ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT key, i, ts, event_id, CAST(3 AS DOUBLE) AS t FROM e WHERE i = 1 UNION ALL SELECT e.key, e.i, e.ts, e.event_id, least(3.0, CASE WHEN b.t >= 1 THEN b.t - 1 ELSE b.t END + (e.ts - b.ts) / 1e6 * (0.005 / 60.0)) FROM b JOIN e ON e.key = b.key AND e.i = b.i + 1)
SELECT key, event_id, t >= 1 AS allowed FROM b""",
    "lru_evict": "WITH l AS (SELECT user_id AS key, max(epoch_us(ts)) AS last FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY last, key) AS i, count(*) OVER () AS n FROM l) SELECT key, last FROM r WHERE n < 64 OR i > n // 2",
    "ttl_fresh": "SELECT ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOURS AS fresh, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1",
    "backoff_schedule": "SELECT CAST(r_regionkey AS BIGINT) AS region, k AS attempt, least(pow(2.0, k), 10.0) * (r_regionkey + 1) AS delay FROM region, range(0, 6) t(k)",
    "transient_errors": "WITH e AS (SELECT event_id, event_id % 9 AS k, event_id % 50 = 8 AS coded FROM events) SELECT event_id, k IN (0, 1) AS rate_limit, k IN (0, 1, 2, 3, 4, 6, 7) OR coded AS transient FROM e",
    "request_validation": """WITH o AS (SELECT o_orderkey AS k FROM orders), m AS (SELECT k, k % 4 <> 0 AS ok, 'failed ' || repeat('ab ', CAST(k % 100 AS INT)) AS s FROM o), n AS (SELECT *, trim(s) AS t FROM m)
SELECT k AS o_orderkey, ok AS cik_ok, k % 5 <> 0 AS accession_ok, CASE WHEN ok THEN CAST(k % 100000 AS VARCHAR) END AS cik, CASE WHEN ok THEN 'CIK' || lpad(CAST(k % 100000 AS VARCHAR), 10, '0') || '.json' END AS facts_file,
 CASE WHEN k % 3 = 0 THEN '10.0.0.' || k % 256 WHEN k % 2 = 0 THEN '192.0.2.1' ELSE 'unknown' END AS client_ip, CASE WHEN length(t) <= 240 THEN t ELSE substring(t, 1, 240) || '...' END AS message FROM n""",
    "catalogue_merge": f"""WITH {FILINGS}, r AS (SELECT *, 'f-' || filing_id AS slug, filing_id IN (SELECT doc_id FROM labels) AS known FROM filings WHERE form_type IN ('10-K', '10-K/A', '10-K405'))
SELECT CAST(CASE WHEN known THEN 0 ELSE 1 END AS BIGINT) AS ord, slug, CASE slug WHEN 'f-0' THEN 'First filing' WHEN 'f-1' THEN 'Second filing' WHEN 'f-4' THEN 'Fifth filing' ELSE slug END AS label, cik, accession, CASE WHEN filing_id % 3 <> 0 THEN form_type ELSE '10-K' END AS form_type, strftime(period_ending, '%Y-%m-%d') AS period_ending,
 CASE WHEN known AND slug = 'f-0' THEN 'a note' WHEN known AND slug = 'f-9' THEN 'another note' WHEN filing_id % 2 = 0 THEN 'even' ELSE '' END AS characteristic, CASE WHEN known THEN 'gold' ELSE 'silver' END AS source FROM r""",
    "extraction": f"""WITH {STRATEGY}, {COVER}, due AS ({_DUE}),
chosen AS (SELECT s.*, NULL AS status_hint FROM sections s JOIN strategy t ON t.filing_id = s.filing_id AND t.source = 'heading' UNION ALL SELECT s.* FROM indexed s JOIN strategy t ON t.filing_id = s.filing_id AND t.source = 'index' UNION ALL SELECT s.*, NULL FROM titles s JOIN strategy t ON t.filing_id = s.filing_id AND t.source = 'title'),
{statuses('typed', 'chosen')}, odd AS (SELECT filing_id FROM filings WHERE {ABS})
SELECT t.filing_id, row_number() OVER (PARTITION BY t.filing_id ORDER BY t.part, CAST(regexp_extract(t.item_number, '^([0-9]+)', 1) AS INT), regexp_extract(t.item_number, '([A-Z]?)$', 1)) - 1 AS ord, CAST(t.part AS BIGINT) AS part, t.item_number, t.status, d.item_number IS NOT NULL AS applicable_in_era, CASE WHEN t.status IN ('incorporated_by_reference', 'partial') THEN v.expected_year END AS expected_year
FROM typed t LEFT JOIN due d ON d.filing_id = t.filing_id AND d.item_number = t.item_number LEFT JOIN cover v ON v.filing_id = t.filing_id WHERE t.filing_id NOT IN (SELECT filing_id FROM odd)
UNION ALL SELECT filing_id, 0, 0, 'abs', 'non_standard', false, NULL FROM odd UNION ALL SELECT filing_id, -1, 0, 'cover', 'incorporated_by_reference', true, expected_year FROM cover""",
    "parts_grouped": f"""WITH {STATUS} SELECT filing_id, ['I', 'II', 'III', 'IV'][part] AS part, count(*) AS n, string_agg(concat_ws('|', item_number, status, {_HTML('substring(item_title, 1, 40)')}, CASE WHEN length(content_text) > 150 THEN 'true' ELSE 'false' END), ';' ORDER BY ord) AS lines FROM classified GROUP BY 1, 2""",
    "date_coercion": "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders) SELECT o_orderkey, coalesce(d, '1900-01-01') AS day, coalesce(d, '') AS shown, CAST(substring(d, 1, 4) AS BIGINT) AS fiscal_year FROM t",
    "conversation_turns": "WITH g AS (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS gap FROM conversations) SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, max(gap) AS widest_gap FROM g GROUP BY 1",
    "page_headings": f"WITH {spans_sql('h', 'pages', 'page_id', 'html', '(?s)<h1>.*?</h1>')} SELECT page_id, start, regexp_replace(hit, '</?h1>', '', 'g') AS heading FROM h",
    "flagship": f"WITH {STATUS} SELECT status, count(*) AS sections, count(DISTINCT filing_id) AS filings, CAST(sum(length(content_text)) AS BIGINT) AS n_chars FROM classified GROUP BY 1",
    "align_cursor": f"WITH RECURSIVE {CURSOR} SELECT * FROM aligned",
    "align_html": f"WITH RECURSIVE {cursor(HTML, 'filing_id % 3 <> 0')} SELECT * FROM aligned",
    "alignment_rates": f"WITH RECURSIVE {CURSOR} SELECT filing_id, count(*) AS items, round(count(start) / count(*), 6) AS text_rate FROM aligned GROUP BY 1",
    "reviewed_statuses": f"""WITH {REVIEWED} SELECT c.filing_id, c.item_number, CASE WHEN j.changed THEN j.most ELSE c.status END AS status,
 CASE WHEN j.n_votes = 0 THEN 'unanswered: item ' || c.item_number WHEN j.changed THEN 'overridden: item ' || c.item_number || ' from extracted to ' || most || ' by ' || CAST(top AS BIGINT) || ' of ' || CAST(n_votes AS BIGINT) WHEN j.n_votes > 0 THEN 'kept: item ' || c.item_number || ' as extracted' END AS warning
 FROM classified c LEFT JOIN judged j ON j.filing_id = c.filing_id AND j.item_number = c.item_number""",
    "review_prompts": f"""WITH {REVIEWED}, texts AS (SELECT filing_id, item_number, content_text AS t FROM classified WHERE {_REASON})
SELECT filing_id, item_number, CAST(0 AS BIGINT) AS turn, 'system' AS role, {q(INSTRUCTION)} AS content FROM texts
UNION ALL SELECT filing_id, item_number, 1, 'user', 'Item ' || item_number || ':' || chr(10) || CASE WHEN length(t) > {PROMPT_CHARS} THEN substring(t, 1, {PROMPT_CHARS}) || {q(CUT_MARK)} ELSE t END FROM texts""",
    "scores_with_errors": f"WITH {WITH_ERRORS} SELECT filing_id, {', '.join(f'round({n}, 6) AS {n}' for n in _RATES)}, error FROM told",
    "result_tallies": f"WITH {WITH_ERRORS} SELECT count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed FROM told",
    "score_report": f"""WITH {SCORES}, r AS (SELECT filing_id, {_RATES['item_recall']} AS a, {_RATES['item_precision']} AS b FROM scored)
SELECT CAST(0 AS BIGINT) AS block, CAST(i AS BIGINT) AS place, line FROM (VALUES (0, '# Scores'), (1, ''), (2, '| filing | item_recall | item_precision |'), (3, '| --- | --- | --- |')) v(i, line)
UNION ALL SELECT 1, filing_id, printf('| %d | %.4f | %.4f |', filing_id, a, b) FROM r UNION ALL SELECT 2, 0, printf('| mean | %.4f | %.4f |', coalesce(avg(a), 0), coalesce(avg(b), 0)) FROM r""",
}
ORACLE_SQL["token_bucket_stream"] = ORACLE_SQL["token_bucket"]
ORACLE_SQL["item_details"] = f"""WITH x AS ({ORACLE_SQL["extraction"]}) SELECT filing_id, item_number, ord, status, NOT applicable_in_era AND status = 'extracted' AS dimmed FROM x QUALIFY row_number() OVER (PARTITION BY filing_id, item_number ORDER BY ord) = 1"""
_WIDE = f"'(?i)^item\\s+' || item_number || {q(f'\\.?\\s*[-{p.DASH}:.]?\\s*([^\\n]{{0,120}}?)\\s\\s')}"
ORACLE_SQL["section_titles"] = f"""WITH labelled AS ({_library('labelled')}), heads AS (SELECT filing_id, item_number, regexp_replace(replace(text, {_NBSP}, ' '), {q('^' + p.ANY_SPACE + '+')}, '') AS head FROM labelled)
SELECT filing_id, item_number, CASE WHEN regexp_matches(head, {_WIDE}) THEN {strip(f'regexp_extract(head, {_WIDE}, 1)')} ELSE {strip(f"substring(regexp_replace(split_part(head, chr(10), 1), '(?i)^item\\s+' || item_number || '\\.?\\s*', ''), 1, 80)")} END AS title FROM heads"""
