"""Sections of filings: by headings, by titles, by a cross-reference index, or as given by a section library.

A filing's sections are found within its row, by functions on arrays of places,
and the strategy is chosen there too: no text is exchanged.  Sections carry ord
(their place), part, item_number, item_title, content_text and, from an index, a
status_hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from .. import patterns as p
from ..functions.status import index_status, once
from ..functions.text import bleed_trimmed, first_group, part_of, section_title, spans, strip

SECTION = ("filing_id", "source", "ord", "part", "item_number", "item_title", "content_text", "status_hint")
PRIORITY = {"heading": 1, "index": 2, "title": 3}


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once, however often it is used: the optimizer doesn't copy what a generator makes."""
    return rows.withColumn(name, F.explode(F.array(value)))


def heading_spans(filings: DataFrame) -> DataFrame:
    """filing_id, start, end, item_number, title of every heading with a valid item number; raw_text stays out."""
    found = filings.select("filing_id", F.explode(spans(F.col("raw_text"), p.HEADING)).alias("m"))
    rows = found.select("filing_id", "m.start", "m.end", F.upper(F.regexp_extract("m.hit", p.HEADING, 1)).alias("item_number"), F.regexp_extract("m.hit", p.HEADING, 2).alias("title"))
    return rows.where(F.col("item_number").isin(*dims.ITEM_NUMBERS))


def best_headings(headings: DataFrame) -> DataFrame:
    """Of each item's headings the one with the most room up to the next heading, the later of equals."""
    following = F.lead("start").over(Window.partitionBy("filing_id").orderBy("start"))
    roomy = headings.withColumn("room", F.coalesce(following - F.col("start"), F.lit(dims.FAR)))
    order = Window.partitionBy("filing_id", "item_number").orderBy(F.desc("room"), F.desc("start"))
    return roomy.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def _firsts(rows: Column) -> Column:
    """Of an array of structs, the least of each item_number, which is their first field; the later fields rank them."""
    return once(F.array_sort(rows), lambda xs: F.filter(xs, lambda x, i: (i == 0) | ~x["item_number"].eqNullSafe(F.get(xs, i - 1)["item_number"])))


def heading_picks(raw_text: Column) -> Column:
    """array of (start, item_number, item_title): of each item's headings the one with the most room, in order."""
    item = lambda m: F.upper(F.regexp_extract(m["hit"], p.HEADING, 1))
    known = F.filter(spans(raw_text, p.HEADING), lambda m: item(m).isin(*dims.ITEM_NUMBERS))

    def ranked(ms: Column) -> Column:
        room = lambda m, i: F.coalesce(F.get(ms, i + 1)["start"] - m["start"], F.lit(dims.FAR))
        return F.transform(ms, lambda m, i: F.struct(item(m).alias("item_number"), (-room(m, i)).alias("less"), (-m["start"]).alias("later"), m["hit"].alias("hit")))

    title = lambda x: strip(F.regexp_replace(strip(F.regexp_extract(x["hit"], p.HEADING, 2)), "\\.+\\z", ""))
    return F.array_sort(F.transform(_firsts(once(known, ranked)), lambda x: F.struct((-x["later"]).alias("start"), x["item_number"].alias("item_number"), title(x).alias("item_title"))))


def title_picks(raw_text: Column) -> Column:
    """array of (start, item_number, item_title): the last match of each item's titles, in order."""
    which = lambda m: F.coalesce(*[F.when(m["hit"].rlike(rx), F.lit(item)) for item, rx in p.TITLE_PATTERNS])
    rows = F.transform(spans(raw_text, p.ANY_TITLE), lambda m: F.struct(which(m).alias("item_number"), (-m["start"]).alias("later"), m["hit"].alias("hit")))
    return F.array_sort(F.transform(_firsts(rows), lambda x: F.struct((-x["later"]).alias("start"), x["item_number"].alias("item_number"), strip(x["hit"]).alias("item_title"))))


def _section(source: str, ord: Column, item: Column, title: Column, content: Column, hint: Column) -> Column:
    return F.struct(
        F.lit(source).alias("source"), ord.cast("int").alias("ord"), part_of(item).alias("part"), item.alias("item_number"), F.substring(title, 1, 120).alias("item_title"), content.alias("content_text"), hint.alias("status_hint")
    )


def _sliced(raw_text: Column, picks: Column, source: str) -> Column:
    """array of sections, from each pick to the next."""

    def cut(ps: Column) -> Column:
        end = lambda i: F.coalesce(F.get(ps, i + 1)["start"], F.length(raw_text))
        body = lambda x, i: strip(F.substring(raw_text, x["start"] + 1, end(i) - x["start"]))
        return F.transform(ps, lambda x, i: _section(source, i, x["item_number"], x["item_title"], body(x, i), F.lit(None).cast("string")))

    return F.filter(once(picks, cut), lambda s: F.length(s["content_text"]) >= dims.SHORTEST_SECTION)


def _exploded(filings: DataFrame, sections: Column) -> DataFrame:
    return _spread(filings.select("filing_id", sections.alias("sections")))


def heading_sections(filings: DataFrame) -> DataFrame:
    text = F.col("raw_text")
    return _exploded(filings, _sliced(text, heading_picks(text), "heading"))


def title_sections(filings: DataFrame) -> DataFrame:
    text = F.col("raw_text")
    return _exploded(filings, _sliced(text, title_picks(text), "title"))


def index_region(raw_text: Column) -> Column:
    """The text behind the first index header; null without one."""
    rx = f"(?d){p.INDEX_HEADER}"
    return F.when(raw_text.rlike(rx), F.get(F.split(raw_text, rx, 2), F.lit(1)))


def index_parts(line: Column) -> Column:
    """(title, ref) of an index line: parts are set apart by two blanks or a tab, the last one refers."""
    parts = F.filter(F.split(strip(line), p.INDEX_SPLIT), lambda x: strip(x) != "")
    title = F.when(F.size(parts) > 1, strip(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " "))).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
    ref = F.when(F.size(parts) > 1, strip(F.get(parts, F.size(parts) - 1))).otherwise(F.lit(""))
    return F.struct(title.alias("title"), ref.alias("ref"))


def _indexed(raw_text: Column) -> Column:
    """array of sections, one for the first line of each item in the cross-reference index; null without an index."""
    line = lambda m: F.struct(F.upper(F.regexp_extract(m["hit"], p.INDEX_LINE, 1)).alias("item_number"), m["start"].alias("start"), index_parts(F.regexp_extract(m["hit"], p.INDEX_LINE, 2)).alias("x"))
    first = lambda region: F.array_sort(F.transform(_firsts(F.transform(spans(region, p.INDEX_LINE), line)), lambda r: F.struct(r["start"].alias("start"), r["item_number"].alias("item_number"), r["x"].alias("x"))))

    def section(r: Column, i: Column) -> Column:
        title, ref = r["x"]["title"], r["x"]["ref"]
        return _section("index", i, r["item_number"], title, strip(F.concat(F.lit("[Cross-reference TOC] "), title, F.lit(" ("), ref, F.lit(")"))), index_status(ref))

    return once(index_region(raw_text), lambda region: F.when(region.isNotNull(), F.transform(first(region), section)))


def index_sections(filings: DataFrame) -> DataFrame:
    """A section for the first line of each item in the cross-reference index."""
    return _exploded(filings, _indexed(F.col("raw_text")))


def _gathered(sections: DataFrame, *keys: str) -> DataFrame:
    """One row per key with its sections, in order, as an array: what is decided about them needs no second pass."""
    rest = [c for c in SECTION if c not in ("filing_id", "ord")]
    return sections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", *rest))).alias("sections"))


def _spread(rows: DataFrame) -> DataFrame:
    return rows.select("filing_id", F.explode("sections").alias("s")).select("filing_id", "s.*").select(*SECTION)


def _chosen(candidates: DataFrame) -> DataFrame:
    """filing_id, source, sections, n by the strategy that each filing takes.

    A whole index first, then whole headings; else the most sections, ties in
    the order heading, index, title.
    """
    rows = _gathered(candidates, "filing_id", "source").withColumn("n", F.size("sections"))
    whole = F.col("n") >= dims.WHOLE_FILING
    rank = F.when((F.col("source") == "index") & whole, 0).when((F.col("source") == "heading") & whole, 1).otherwise(2)
    order = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    best = Window.partitionBy("filing_id").orderBy(rank, F.when(rank == 2, -F.col("n")).otherwise(0), F.element_at(order, F.col("source")))
    return rows.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def strategies(candidates: DataFrame) -> DataFrame:
    """filing_id, source, n of the strategy that each filing takes."""
    return _chosen(candidates).select("filing_id", "source", "n")


def chosen(filings: DataFrame, *keep: str) -> DataFrame:
    """filing_id, the columns to keep, sections of the strategy that each filing takes; filings without any section are left out."""
    text = F.col("raw_text")
    n = lambda name: F.coalesce(F.size(f"by_{name}"), F.lit(0))
    # a whole index or whole headings decide, so what ranks behind them is not looked for
    rows = held(filings, "by_index", _indexed(text))
    rows = held(rows, "by_heading", F.when(n("index") < dims.WHOLE_FILING, _sliced(text, heading_picks(text), "heading")))
    rows = held(rows, "by_title", F.when(F.greatest(n("index"), n("heading")) < dims.WHOLE_FILING, _sliced(text, title_picks(text), "title")))
    most = F.greatest(*[n(name) for name in PRIORITY])
    best = F.when(n("index") >= dims.WHOLE_FILING, F.col("by_index")).when(n("heading") >= dims.WHOLE_FILING, F.col("by_heading"))
    for name in sorted(PRIORITY, key=PRIORITY.get):
        best = best.when(n(name) == most, F.col(f"by_{name}"))
    return rows.where(most > 0).select("filing_id", *keep, best.alias("sections"))


def pattern_sections(filings: DataFrame) -> DataFrame:
    """Sections by the strategy that each filing takes."""
    return _spread(chosen(filings))


def _start(content: Column, item: Column) -> Column:
    return F.struct(F.substring(strip(F.coalesce(content, F.lit(""))), 1, 500).alias("start"), item.alias("item_number"))


def _suspect(starts: Column) -> Column:
    """Whether sections, given by their starts, are too few for a whole filing, or two items among them start alike."""
    pairs = F.array_distinct(F.filter(starts, lambda x: x["start"] != ""))
    alike = F.size(pairs) > F.size(F.array_distinct(F.transform(pairs, lambda x: x["start"])))
    return (F.coalesce(F.size(starts), F.lit(0)) < dims.WHOLE_FILING) | F.coalesce(alike, F.lit(False))


def suspect_coverage(sections: DataFrame) -> DataFrame:
    """filing_id, n, suspect: fewer than a whole filing's sections, or two items that start alike."""
    rows = sections.groupBy("filing_id").agg(F.collect_list(_start(F.col("content_text"), F.col("item_number"))).alias("starts"))
    return rows.select("filing_id", F.size("starts").alias("n"), _suspect(F.col("starts")).alias("suspect"))


def library_sections(library: DataFrame) -> DataFrame:
    """Sections of a section library's output; library: filing_id, keyed (array of key and text), labelled (array of label and text).

    Keyed sections come first; a label is taken for an item that none has, the
    first of repeated ones.
    """
    def texts(kind: str) -> DataFrame:
        rows = library.select("filing_id", F.posexplode(kind).alias("ord", "s")).select("filing_id", "ord", strip(F.col("s.key")).alias("key"), F.col("s.key").alias("label"), F.col("s.text").alias("text"))
        return held(held(rows, "text", strip(F.col("text"))), "content_text", bleed_trimmed(F.col("text")))

    number = F.create_map(*[F.lit(x) for x in ("i", 1, "ii", 2, "iii", 3, "iv", 4)])
    keyed = texts("keyed").where(F.col("key").rlike(p.SECTION_KEY) & (F.col("content_text") != "")).select("filing_id", "ord", F.element_at(number, F.lower(F.regexp_extract("key", p.SECTION_KEY, 1))).alias("part"), F.upper(F.regexp_extract("key", p.SECTION_KEY, 2)).alias("item_number"), "content_text")
    labelled = texts("labelled").select("filing_id", "ord", F.upper(first_group(F.col("label"), p.ITEM_LABEL, 1)).alias("item_number"), "content_text")
    labelled = labelled.where("item_number IS NOT NULL AND content_text <> ''").join(keyed, ["filing_id", "item_number"], "left_anti")
    once = Window.partitionBy("filing_id", "item_number").orderBy("ord")
    labelled = labelled.withColumn("n", F.row_number().over(once)).where("n = 1").select("filing_id", (F.col("ord") + 1000).alias("ord"), part_of(F.col("item_number")).alias("part"), "item_number", "content_text")
    rows = keyed.unionByName(labelled)
    return rows.select("filing_id", F.lit("lib").alias("source"), "ord", "part", "item_number", section_title(F.col("content_text"), F.col("item_number")).alias("item_title"), "content_text", F.lit(None).cast("string").alias("status_hint"))


def merged(library: DataFrame, patterns: DataFrame, filings: DataFrame) -> DataFrame:
    """filing_id, sections: those of the library, but pattern sections for a suspect filing (not asset-backed) that has strictly more of them; patterns: ``chosen``."""
    order = ("ord", "source", "part", "item_number", "item_title", "content_text", "status_hint")
    lib = library.groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("sections"))
    pat = patterns.select("filing_id", F.transform("sections", lambda x: F.struct(*[x[n].alias(n) for n in order])).alias("others"))
    rows = filings.select("filing_id", "is_abs").join(lib, "filing_id", "left").join(pat, "filing_id", "left")
    n = F.coalesce(F.size("sections"), F.lit(0))
    suspect = _suspect(F.transform("sections", lambda x: _start(x["content_text"], x["item_number"])))
    by_pattern = ~F.col("is_abs") & suspect & (F.coalesce(F.size("others"), F.lit(0)) > n)
    return rows.select("filing_id", F.when(by_pattern, F.col("others")).otherwise(F.col("sections")).alias("sections"))


def merged_sections(library: DataFrame, patterns: DataFrame, filings: DataFrame) -> DataFrame:
    return _spread(merged(library, patterns, filings))


def _place(part: Column, item: Column) -> list[Column]:
    """What document order goes by: part, item number and letter; unreadable numbers after the others of their part."""
    digits, letter = F.regexp_extract(item, "^([0-9]+)([A-Za-z]?)", 1), F.upper(F.regexp_extract(item, "^([0-9]+)([A-Za-z]?)", 2))
    known = digits != ""
    return [F.coalesce(part, F.lit(99)), F.when(known, digits.try_cast("int")).otherwise(999), F.when(known, letter).otherwise(item), item]


def document_order(sections: DataFrame) -> DataFrame:
    """Sections with ord by document order."""
    order = Window.partitionBy("filing_id").orderBy(*_place(F.col("part"), F.col("item_number")))
    return sections.withColumn("ord", F.row_number().over(order) - 1)


def in_document_order(sections: Column) -> Column:
    """An array of one filing's sections in document order, with ord by it."""
    rest = [c for c in SECTION if c not in ("filing_id", "source", "ord")]
    placed = F.transform(sections, lambda s: F.struct(*[x.alias(f"k{i}") for i, x in enumerate(_place(s["part"], s["item_number"]))], s["ord"].alias("ord"), s.alias("s")))
    return F.transform(F.array_sort(placed), lambda x, i: F.struct(i.cast("int").alias("ord"), *[x["s"][c].alias(c) for c in rest]))
