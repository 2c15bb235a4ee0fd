"""Character ranges of sections within their source.

The exact case is a fold of built-in functions over a filing's sections in
order, each search starting where the last successful one ended.  Sections that
the exact search misses need a longest common block, which Spark has no
function for; ``align_fuzzy`` runs the whole ladder in one Python function a
filing.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import strip
from ..patterns import NBSP

# Fixed values
PRINT_LENGTH, PRINT_LEAST, PRINT_OFFSETS = 120, 40, (0, 200, 500)
LEAST_SHARE, TOLERANT_SHARE, TOLERANT_LEAST, TOLERANT_MOST = 0.5, 0.8, 4, 20
RANGE = "struct<start:int,end:int>"
BLOCK_BYTES = 8 << 20


def bare_body(segment: Column) -> Column:
    """The segment behind its header: after an early line end, else after an early double blank."""
    text = strip(F.replace(segment, F.lit(NBSP), F.lit(" ")))

    def cut(t: Column) -> Column:
        line, wide = F.locate("\n", t) - 1, F.locate("  ", t, 51) - 1
        rest = lambda at: strip(F.substring(t, at, F.length(t)))
        return F.when((line > 0) & (line < 200), rest(line + 2)).when((wide > 0) & (wide < 200), rest(wide + 3)).otherwise(t)

    return F.get(F.transform(F.array(text), cut), F.lit(0))


def header_length(segment: Column, body: Column) -> Column:
    return F.when(body == "", 0).otherwise(F.greatest(F.call_function("locate", F.substring(body, 1, 40), segment) - 1, F.lit(0)))


def exact_range(segment: Column, source: Column, least: Column) -> Column:
    """(start, end) of the segment by the first of its prints that the source has from ``least`` on, else null."""

    def by_body(body: Column) -> Column:
        found = None
        for offset in PRINT_OFFSETS:
            mark = F.substring(body, offset + 1, PRINT_LENGTH)
            at = F.call_function("locate", mark, source, least + 1) - 1
            start = F.greatest(at - least - offset - header_length(segment, body), F.lit(0)) + least
            hit = F.when((F.length(mark) >= PRINT_LEAST) & (at >= 0), F.struct(start.alias("start"), F.least(start + F.length(segment), F.length(source)).alias("end")))
            found = hit if found is None else F.coalesce(found, hit)
        return found

    return F.get(F.transform(F.array(bare_body(segment)), by_body), F.lit(0))




def exact_ranges(parts: Column, source: Column) -> Column:
    """array of (ord, item_number, range) of a filing's sections in order: exact ranges along a cursor that only a success moves forward."""
    none = F.array().cast(f"array<struct<ord:int,item_number:string,range:{RANGE}>>")

    def step(acc: Column, s: Column) -> Column:
        found = exact_range(s["content_text"], source, acc["at"])
        return F.get(
            F.transform(F.array(found), lambda r: F.struct(F.coalesce(r["end"], acc["at"]).alias("at"), F.array_append(acc["out"], F.struct(s["ord"].cast("int").alias("ord"), s["item_number"].alias("item_number"), r.alias("range"))).alias("out"))), F.lit(0)
        )

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def align_exact(sections: DataFrame, filings: DataFrame) -> DataFrame:
    """filing_id, ord, item_number, range: ``exact_ranges`` of every filing's sections."""
    gathered = sections.groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("ord", "item_number", "content_text"))).alias("parts"))
    rows = gathered.join(filings.select("filing_id", "raw_text"), "filing_id")
    return rows.select("filing_id", F.explode(exact_ranges(F.col("parts"), F.col("raw_text"))).alias("p")).select("filing_id", "p.ord", "p.item_number", "p.range")


def longest_block(source: str, mark: str) -> tuple[int, int, int]:
    """(size, place in source, place in mark) of the longest common block, the earliest in source, then in mark.

    Suffix automaton of the mark, so the source is read once whatever its size.
    """
    link, length, step, end = [-1], [0], [{}], [0]
    last = 0
    for i, c in enumerate(mark):
        cur = len(link)
        link.append(0), length.append(length[last] + 1), step.append({}), end.append(i + 1)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = cur
            at = link[at]
        if at >= 0:
            q = step[at][c]
            if length[at] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(link)
                link.append(link[q]), length.append(length[at] + 1), step.append(dict(step[q])), end.append(end[q])
                while at >= 0 and step[at].get(c) == q:
                    step[at][c] = copy
                    at = link[at]
                link[q] = link[cur] = copy
        last = cur
    best, state, size = (0, 0, 0), 0, 0
    for i, c in enumerate(source):
        while state and c not in step[state]:
            state = link[state]
            size = length[state]
        if c in step[state]:
            state, size = step[state][c], size + 1
        else:
            size = 0
        if size > best[0]:
            best = (size, i + 1 - size, end[state] - size)
    return best


def _header(segment: str) -> str:
    text = segment.replace(NBSP, " ").strip()
    for at, skip in ((text.find("\n"), 1), (text.find("  ", 50), 2)):
        if 0 < at < 200:
            return text[at + skip :].strip()
    return text


def range_of(segment: str, source: str, least: int = 0) -> tuple[int, int] | None:
    """The best-trusted place of the segment from ``least`` on: exact, by longest block, or but for white space."""
    rest = source[least:] if segment and source else ""
    body = _header(segment) if rest else ""
    head = max(segment.find(body[:40]), 0) if body else 0
    trusted: tuple[int, int] | None = None
    for offset in PRINT_OFFSETS if body else ():
        mark = body[offset : offset + PRINT_LENGTH]
        if len(mark) < PRINT_LEAST:
            continue
        ways = []
        at = rest.find(mark)
        exact = at >= 0
        if exact:
            ways.append((len(mark), at))
        else:
            size, a, b = longest_block(rest, mark)
            if size >= int(LEAST_SHARE * len(mark)):
                ways.append((size, max(0, a - b)))
            tokens = mark.split()
            if len(tokens) >= TOLERANT_LEAST and (m := re.search(r"\s+".join(map(re.escape, tokens[:TOLERANT_MOST])), rest)):
                ways.append((int(TOLERANT_SHARE * len(mark)), m.start()))
        for trust, found in ways:
            if trusted is None or trust > trusted[0]:
                trusted = (trust, max(0, found - offset - head))
        if exact:
            break
    return None if trusted is None else (least + trusted[1], least + min(len(rest), trusted[1] + len(segment)))


def align_fuzzy(sections: DataFrame, filings: DataFrame) -> DataFrame:
    """As ``align_exact``, with sections that differ from their source in places; one filing at a time."""
    parts = sections.groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("ord", "item_number", "content_text"))).alias("parts"))
    rows = parts.join(filings.select("filing_id", "raw_text"), "filing_id")

    def run(batches):
        for pdf in batches:
            out = []
            for filing, items, source in zip(pdf["filing_id"], pdf["parts"], pdf["raw_text"], strict=True):
                at = 0
                for s in items:
                    found = range_of(s["content_text"], source or "", at)
                    at = found[1] if found else at
                    out.append((filing, s["ord"], s["item_number"], {"start": found[0], "end": found[1]} if found else None))
            yield pd.DataFrame(out, columns=["filing_id", "ord", "item_number", "range"])

    return rows.mapInPandas(run, f"filing_id long, ord int, item_number string, range {RANGE}")


def _blocks(items: DataFrame, block_bytes: int):
    """The distinct items with an id and a text, about block_bytes of text at a time."""
    items = items.toDF("item_id", "text").where("item_id IS NOT NULL AND text <> ''").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(size) // block_bytes)
    for i in range(n):
        if block := [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()]:
            yield block


def passages(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start of every place where a document's text holds an item's whole text.

    docs: an id and a text; items: an id and a text.  The items are a stated
    query set: a block of them at a time, of a bounded size, becomes one
    automaton that reads every document once.  Null texts hold nothing, empty
    and null items are nowhere, repeated items count once.
    """
    doc_type, item_type = docs.schema[0].dataType.simpleString(), items.schema[0].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, start long"
    out = None
    for block in _blocks(items, block_bytes):
        found = docs.toDF("doc_id", "text").where("text IS NOT NULL").mapInArrow(_reader(docs.sparkSession.sparkContext.broadcast(block), to_arrow_type(items.schema[0].dataType)), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _reader(held, item_type: pa.DataType):
    def run(batches):
        import ahocorasick

        known: dict[str, list] = {}
        for item_id, text in held.value:
            known.setdefault(text, []).append(item_id)
        automaton = ahocorasick.Automaton()
        for text, ids in known.items():
            automaton.add_word(text, (len(text), ids))
        automaton.make_automaton()
        for batch in batches:
            row, item, start = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for end, (n, ids) in automaton.iter(text):
                    for item_id in ids:
                        row.append(i), item.append(item_id), start.append(end + 1 - n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(item, item_type), pa.array(start, pa.int64())], ["doc_id", "item_id", "start"])

    return run


def span_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over union of two half-open spans; 0 for null or inverted ones, 1 for two equal empty ones."""
    inter = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    union = (a_end - a_start) + (b_end - b_start) - inter
    return (
        F.when(a_start.isNull() | a_end.isNull() | b_start.isNull() | b_end.isNull(), 0.0)
        .when((a_end < a_start) | (b_end < b_start), 0.0)
        .when(union == 0, F.when((a_start == b_start) & (a_end == b_end), 1.0).otherwise(0.0))
        .otherwise(inter / union.cast("double"))
    )


