"""Unit cases of the column functions, each on a one-column frame."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tomeloom import patterns
from tomeloom.functions import status as st
from tomeloom.functions import text as tx
from tomeloom.operators import align, facts, limits
from tomeloom.sources import filings as src

PROXY = "The information required by this Item is incorporated herein by reference to the 2025 Proxy Statement."


def run(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_status(spark):
    filler = "Sentences about the business of the company go on. " * 40
    cases = [
        (None, "extracted"), ("", "extracted"), ("Item 6. [Reserved]", "reserved"), ("Item 6. [ RESERVED ]", "reserved"), ("Item 1B. Unresolved Staff Comments  None.", "not_applicable"),
        ("Mine Safety DisclosuresNot applicable.", "not_applicable"), ("Item 4. Mine Safety Disclosures\nNot applicable.Apple Inc. | 2024 Form 10-K | 17", "not_applicable"),
        ("Not applicable. PART III", "not_applicable"), ("Item 11. Executive Compensation " + PROXY, "incorporated_by_reference"), (filler + PROXY, "partial"),
        ("The policy is attached. The remaining information required by this Item will be included in the 2025 Proxy Statement.", "partial"),
        ("See our 2024 Proxy Statement for more.", "incorporated_by_reference"), (filler, "extracted"),
        ("Information required by this item. Contents of websites referenced in it are not incorporated by reference.", "extracted"), ("[Reserved] " + "word " * 100, "extracted"),
    ]
    assert run(spark, [c[0] for c in cases], st.status_of) == [c[1] for c in cases]


def test_spans_follow_python(spark):
    import re

    rng = random.Random(3)
    texts = ["", "Item 1. A\nItem 1A.\n\nRisk", "é—Item 2. x\n  Item 3: Legal\n"]
    texts += ["".join(rng.choice(["Item 7. ", "ITEM 1A - T", "\n", "é", " ", " ", "—", "x", "Item 405. "]) for _ in range(60)) for _ in range(60)]
    got = run(spark, texts, lambda x: F.transform(tx.spans(x, patterns.HEADING), lambda m: F.struct(m["start"], m["end"], m["hit"])))
    assert [[tuple(m) for m in ms] for ms in got] == [[(m.start(), m.end(), m.group()) for m in re.finditer(patterns.HEADING, t)] for t in texts]


def test_cover_reference(spark):
    cases = [
        ("DOCUMENTS INCORPORATED BY REFERENCE\nAct of 1933. Portions of the 2025 Proxy Statement", ("DEF 14A", 2025)), ("Documents incorporated by reference: the 1998 annual meeting", ("DEF 14A", 1998)),
        ("no block, 2025 proxy statement", None), ("DOCUMENTS INCORPORATED BY REFERENCE none", None), (None, None),
    ]
    assert [tuple(r) if r else None for r in run(spark, [c[0] for c in cases], st.cover_reference)] == [c[1] for c in cases]


def test_bleed_title_and_parts(spark):
    long = "x" * 120
    got = run(spark, ["Item 1. A b Item 2. c", "Item 1. only", long + " PART II Item 5", "PART II Item 5 " + long, long + " PART IV Item 15"], tx.bleed_trimmed)
    assert got == ["Item 1. A b", "Item 1. only", long, "PART II Item 5 " + long, long + " PART IV Item 15"]
    assert run(spark, ["Item 1A.  Risk Factors  body", "Item 1A. Risk\nbody", "no prefix at all"], lambda x: tx.section_title(x, F.lit("1A"))) == ["Risk Factors", "Risk", "no prefix at all"]
    assert run(spark, ["1", "9C", "15", "cover", None], tx.part_of) == [1, 2, 4, 0, 0]
    assert run(spark, ["About Item 1105 of Regulation AB", "asset-backed", " " * 20000 + "regulation ab"], tx.looks_asset_backed) == [True, False, False]
    assert run(spark, [1, 4, 9], tx.roman, "int") == ["I", "IV", "9"]
    assert run(spark, ["<a href=\"x\">'&'</a>"], tx.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"]
    assert run(spark, ["a\nb", "y" * 300], tx.shorten) == ["a b", "y" * 240 + "..."]


def test_ballots_and_triggers(spark):
    ballots = ['{"status": "Extracted "}', '```json\n{"status": "partial"}\n```', 'I say {"status": "reserved"} here', '{"status": 3}', "nothing", '{"status": "odd"}', '[{"status": "partial"}]', None]
    assert run(spark, ballots, st.ballot_status) == ["extracted", "partial", "reserved", None, None, None, None, None]
    long = "word " * 120
    texts = ["short", long, long + " incorporated by reference", long + " see Item 7A", long + " additional information by this Item", "[Cross-reference TOC] x"]
    got = run(spark, texts, lambda x: st.review_reason(F.lit("extracted"), x))
    assert [g and g.split(" ")[0] for g in got] == ["short", None, "contains", "contains", "contains", None]
    assert run(spark, texts, lambda x: st.review_reason(F.lit("partial"), x)) == [None] * 6


def test_iou(spark):
    cases = [((0, 10), (5, 15), 5 / 15), ((0, 0), (0, 0), 1.0), ((0, 0), (1, 1), 0.0), ((5, 3), (0, 9), 0.0), (None, (0, 1), 0.0), ((0, 4), (4, 8), 0.0), ((2, 6), (2, 6), 1.0)]
    rows = spark.createDataFrame([(i, *(a or (None, None)), *(b or (None, None))) for i, (a, b, _) in enumerate(cases)], "i int, a int, b int, c int, d int")
    got = [r[0] for r in rows.orderBy("i").select(align.span_iou(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == pytest.approx([x[2] for x in cases])


def test_value_in_text(spark):
    cases = [(391035.0, "sales of 391,035", "exact"), (391035000000.0, "$391.0 billion", "billions"), (1500000.0, "1.5 million", "millions"), (0.0, "0", None), (-2500.0, "about 2.5 thousand", "thousands"), (77.0, "none", None)]
    rows = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(cases)], "i int, v double, t string")
    got = [r[0] for r in rows.orderBy("i").select(facts.match_form(F.col("v"), F.col("t"))).collect()]
    assert got == [x[2] for x in cases]


def test_retry(spark):
    said = ["HTTP 429", "502 bad", "code: 504", "5028", "Read Timeout", "fine"]
    assert run(spark, said, lambda x: limits.is_transient(x, F.lit(None).cast("int"))) == [True, True, True, False, True, False]
    assert run(spark, ["x"], lambda x: limits.is_transient(x, F.lit(503))) == [True]
    assert run(spark, ["x"], lambda x: limits.backoff(1.0, 6.0, 5)) == [[1.0, 2.0, 4.0, 6.0]]


def test_facts_file_and_freshness(spark):
    assert run(spark, [320193], src.facts_file, "int") == ["CIK0000320193.json"]
    now = F.lit(datetime.datetime(2024, 1, 2, 12))
    assert run(spark, [datetime.datetime(2024, 1, 1, 13), datetime.datetime(2024, 1, 1, 11)], lambda x: src.is_fresh(x, now), "timestamp") == [True, False]


def test_longest_block_follows_difflib():
    from difflib import SequenceMatcher

    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(2))
        m = SequenceMatcher(a=a, b=b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
        assert align.longest_block(a, b)[0] == m.size
        if m.size:
            assert align.longest_block(a, b) == (m.size, m.a, m.b)


def test_range_of():
    body = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."
    source = "cover page\n" + body + "\nmore\n" + body
    assert align.range_of(body, source) == (11, 11 + len(body))
    assert align.range_of(body, source, 20)[0] == source.rindex(body)
    assert align.range_of("Item 1. Title\n" + body, "Item 1. Title\n" + body) == (0, 14 + len(body))
    assert align.range_of(body, source.replace(" ", "  ")) is not None
    assert align.range_of("", source) is None and align.range_of(body, "") is None and align.range_of("tiny", source) is None


def test_strip_follows_python(spark):
    texts = [None, "", " \t\n", "é", "x"] + [f"{c}{c}a{c} é{c}{c}" for c in map(chr, range(1, 0x3002)) if c.isspace()] + ["​zero width​", "　— "]
    assert run(spark, texts, tx.strip) == [t and t.strip() for t in texts]
    assert run(spark, texts, tx.rstrip) == [t and t.rstrip() for t in texts]
