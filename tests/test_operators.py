"""Relational operators on small frames."""

import json

from pyspark.sql import functions as F

from tomeloom.operators import align, evaluate, facts, limits, segment, votes
from tomeloom.sources import filings as src
from tomeloom.sources import results
from tomeloom.streaming import limiter

BODY = "Text of this section that is long enough to be kept as a section of its own."


def filing(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "filing_id long, raw_text string")


def test_headings_skip_contents_and_unknown_numbers(spark):
    contents = "\n".join(f"Item {n}. T{n}" for n in ("1", "1A", "2"))
    body = "\n".join(f"Item {n}. Title {n}.\n{BODY}" for n in ("1", "1A", "2", "405"))
    got = segment.heading_sections(filing(spark, f"{contents}\n{body}", "", None)).orderBy("ord").collect()
    assert [(r.filing_id, r.item_number, r.item_title, r.part) for r in got] == [(0, "1", "Title 1", 1), (0, "1A", "Title 1A", 1), (0, "2", "Title 2", 1)]
    assert all(r.content_text.endswith(BODY) for r in got[:2])


def test_index_sections(spark):
    text = "x\nFORM 10-K CROSS REFERENCE INDEX\nItem 1.  Business  5-43\nItem 1B.  Staff Comments  Not applicable\nItem 10.  Directors  (a)\nItem 1.  Business again  9\nItem 99.  Odd\n"
    got = segment.index_sections(filing(spark, text, "no index")).orderBy("ord").collect()
    assert [(r.item_number, r.part, r.item_title, r.status_hint) for r in got] == [("1", 1, "Business", "extracted"), ("1B", 1, "Staff Comments", "not_applicable"), ("10", 3, "Directors", "incorporated_by_reference"), ("99", 0, "Odd", "extracted")]
    assert got[0].content_text == "[Cross-reference TOC] Business (5-43)"


def test_strategy_ties_go_to_headings(spark):
    rows = [(0, "heading", 3), (0, "index", 3), (0, "title", 3), (1, "index", 8), (1, "heading", 20), (2, "heading", 2), (2, "title", 5)]
    made = spark.createDataFrame([(f, s, i, 1, str(i), "t", "c", None) for f, s, n in rows for i in range(n)], "filing_id long, source string, ord int, part int, item_number string, item_title string, content_text string, status_hint string")
    assert {r.filing_id: r.source for r in segment.strategies(made).collect()} == {0: "heading", 1: "index", 2: "title"}


def test_suspect_coverage(spark):
    rows = [(0, str(i), f"content {i}") for i in range(8)] + [(1, str(i), "the same") for i in range(9)] + [(2, "1", "few")] + [(3, str(i), "") for i in range(9)]
    made = spark.createDataFrame(rows, "filing_id long, item_number string, content_text string")
    assert {r.filing_id: r.suspect for r in segment.suspect_coverage(made).collect()} == {0: False, 1: True, 2: True, 3: False}


def test_document_order(spark):
    made = spark.createDataFrame([(0, p, n) for p, n in ((1, "1A"), (2, "10"), (2, "9"), (1, "1"), (1, "2"), (2, "odd"))], "filing_id long, part int, item_number string")
    assert [r.item_number for r in segment.document_order(made).orderBy("ord").collect()] == ["1", "1A", "2", "9", "10", "odd"]


def test_votes(spark):
    ballots = spark.createDataFrame(
        [(0, "7", 0, "a"), (0, "7", 1, "a"), (0, "7", 2, "b"), (1, "7", 0, "a"), (1, "7", 1, "b"), (2, "7", 0, "b"), (2, "7", 1, "a"), (3, "7", 0, None)], "filing_id long, item_number string, provider_pos int, value string"
    )
    asked = spark.createDataFrame([(0, "7", "x"), (1, "7", "x"), (2, "7", None), (3, "7", "x")], "filing_id long, item_number string, fallback string")
    got = {r.filing_id: (r.pick, r.n_top, r.n_votes, r.fallback_used) for r in votes.tally(ballots, asked).collect()}
    assert got == {0: ("a", 2, 3, False), 1: ("x", 0, 2, True), 2: ("b", 1, 2, False), 3: ("x", 0, 0, True)}
    items = asked.select("filing_id", "item_number", F.lit("b").alias("status"))
    assert {r.filing_id: r.status for r in votes.overridden(votes.tally(ballots, asked), items).collect()} == {0: "a", 1: "b", 2: "b", 3: "b"}
    assert {r.filing_id: r.value for r in votes.first_calls(ballots).collect()}[2] == "b"


def test_scores_of_nothing_are_zero(spark):
    schema = "filing_id long, ord int, item_number string, status string"
    got = spark.createDataFrame([(0, 0, "1", "extracted"), (0, 1, "1a", "partial"), (0, -1, "cover", "partial")], schema)
    want = spark.createDataFrame([(0, 0, "1", "extracted"), (0, 1, "1A", "extracted"), (0, 2, "2", "reserved"), (1, 0, "1", "extracted")], schema)
    r = {x.filing_id: x for x in evaluate.ratios(evaluate.scores(got, want)).collect()}
    assert (r[0].item_recall, r[0].item_precision, r[0].status_accuracy, r[0].full_match_rate) == (2 / 3, 1.0, 0.5, 1 / 3)
    assert (r[1].item_recall, r[1].item_precision, r[1].status_accuracy) == (0.0, 0.0, 0.0)


def company(values):
    return json.dumps({"cik": 1, "facts": {"dei": {"Other": {"units": {}}}, "us-gaap": {c: {"units": {"USD": [{"val": v, "accn": a, "fy": fy, "fp": fp, "form": "10-K"} for v, a, fy, fp in fs]}} for c, fs in values.items()}}})


def test_facts_report(spark):
    c = company({"Revenues": [(5e9, "A", 2023, "FY"), (6e9, "A", 2024, "FY"), (1e9, "B", 2024, "FY")], "Assets": [(7.0, "A", 2024, "Q1")], "SalesRevenueNet": [(1.0, "A", 2024, "FY")]})
    comp = spark.createDataFrame([(0, "A", c), (1, "Z", c), (2, "A", None)], "filing_id long, accession string, company string")
    rows = facts.unnested(comp)
    assert rows.count() == 4
    heads = comp.select("filing_id", "accession", F.lit("2024-12-31").alias("period_ending"), F.col("company").isNotNull().alias("has_company"))
    items = spark.createDataFrame([(0, 0, "8", "extracted", "Sales were $6.0 billion.")], "filing_id long, ord int, item_number string, status string, content_text string")
    r = {x.filing_id: x for x in facts.report(heads, rows, items).collect()}
    assert [(x.concept, x.xbrl_value, x.match_form) for x in r[0].numeric_reconciliations] == [("Revenues", 6e9, "billions"), ("Assets", 7.0, None)]
    assert r[0].has_xbrl_data and not r[0].item_8_status_consistent and r[0].period_aligned and len(r[0].warnings) == 2
    assert not r[1].has_xbrl_data and r[1].warnings[0].startswith("no_facts") and "none of" in r[1].warnings[0]
    assert not r[2].has_xbrl_data and r[2].warnings[0].startswith("no_company")


def test_token_bucket(spark):
    rows = spark.createDataFrame([("k", 0, i) for i in range(4)] + [("k", 20_000_000, 4)], "key string, ts long, event_id long")
    got = [(r.allowed, round(r.wait, 3)) for r in limits.allowances(rows, 3, 6).orderBy("event_id").collect()]
    assert got == [(True, 0.0)] * 3 + [(False, 10.0), (True, 0.0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, t * 7_000_000, k * 100 + t) for k in range(3) for t in range(12)], "key long, ts long, event_id long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = limiter.collected(limiter.stream_allowances(stream, 2, 6)).orderBy("event_id").collect()
    assert got == limits.allowances(rows, 2, 6).orderBy("event_id").select("key", "event_id", "allowed", "wait").collect()


def test_eviction(spark):
    rows = spark.createDataFrame([(k, k // 3) for k in range(101)], "key long, last long")
    assert sorted(r.key for r in limits.kept_buckets(rows, 64).collect()) == list(range(50, 101))
    assert limits.kept_buckets(rows, 500).count() == 101


def test_expectation_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"filing": {"cik": "1", "accession": "A"}, "expected_items": [{"part": 1, "item_number": "1", "status": "extracted"}]}))
    assert [tuple(r) for r in src.gold_items(src.read_gold(spark, str(tmp_path / "a.json"))).collect()] == [("A", 0, "1", "extracted")]
    (tmp_path / "s.json").write_text(json.dumps({"filings": [{"key": "k", "cik": "1", "accession": "A", "expected": {"min_items": 3, "must_have_status": {"1": ["extracted"]}, "is_abs": False}}, {"key": "other", "accession": "B"}]}))
    silver = src.silver_constraints(src.read_silver(spark, str(tmp_path / "s.json"), "k"))
    got = spark.createDataFrame([("A", 0, "2", "partial")], "filing_id string, ord int, item_number string, status string")
    assert evaluate.violations(got, silver).collect()[0].violations == ["min_items=3 but got 1", "required item 1 missing"]


def test_result_sink_builds_once(spark, tmp_path):
    items = spark.createDataFrame([(i, 0, "1", "extracted") for i in range(3)], "filing_id long, ord int, item_number string, status string")
    heads = items.select("filing_id", F.lit("10-K").alias("form_type"))
    docs = results.assembled(heads, items)
    at = str(tmp_path / "out")
    results.write_results(docs.where("filing_id < 2"), at)
    assert {r.filing_id for r in results.missing(docs, at, "filing_id").collect()} == {2}
    results.write_results(docs, at)
    assert results.read_result(spark, at, "2").count() == 1 and spark.read.json(at).count() == 3
    assert results.markdown(evaluate.ratios(evaluate.scores(items, items))).orderBy("line").first().line.startswith("| 0 |")


def test_find_filing(spark):
    import pytest

    rows = spark.createDataFrame([("1", "A", "10-K"), ("1", "B", "8-K")], "cik string, accession string, form_type string")
    assert src.find_filing(rows, "1", "A").count() == 1
    with pytest.raises(Exception, match="no annual report"):
        src.find_filing(rows, "1", "B").collect()


def test_passages(spark, monkeypatch):
    long = "z" * 45
    docs = [(1, f"zz {long} here and zz {long} here"), (2, "aaaaa"), (3, None), (4, ""), (5, "é\ttab here"), (None, "aaa")]
    items = [(1, f"zz {long} here"), (2, "aa"), (3, "\ttab"), (4, ""), (5, None), (None, "aa"), (2, "aa"), (6, "aa"), (7, f"{long} he")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = [(1, 1, 0), (1, 1, 58), (1, 7, 3), (1, 7, 61), *[(d, i, s) for d, n in ((2, 4), (None, 2)) for i in (2, 6) for s in range(n)], (5, 3, 1)]
    for block_bytes in (1 << 20, 20):
        assert sorted((tuple(r) for r in align.passages(docs, items, block_bytes).collect()), key=repr) == sorted(want, key=repr)
    assert align.passages(docs, items.limit(0)).count() == 0


def test_a_hot_key_takes_time_in_proportion(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        rows = spark.range(n).selectExpr("1L AS key", "id * 1000000 AS ts", "id AS event_id")
        began = time.perf_counter()
        got = limits.allowances(rows, 3, 6).where("allowed").count()
        took.append(time.perf_counter() - began)
        tokens, want = 3.1, 0
        for _ in range(n):
            tokens = min(3.0, tokens + 0.1)
            want, tokens = want + (tokens >= 1), tokens - (tokens >= 1)
        assert got == want
    assert took[1] < 8 * took[0] + 2


def test_review_changes_doubtful_sections(spark):
    from tomeloom.operators import review

    rows = [(1, 0, "1", "extracted", "short"), (1, 1, "2", "extracted", "x" * 5_000 + " see Item 7"), (1, 2, "3", "reserved", "short"), (2, 0, "1", "extracted", "y" * 600)]
    sections = spark.createDataFrame(rows, "filing_id long, ord int, item_number string, status string, content_text string")
    said = [(1, "1", i, '{"status": "reserved"}' if i else "?") for i in range(3)] + [(2, "1", 0, '{"status": "reserved"}')]
    got = {(r.filing_id, r.item_number): (r.status, r.warning) for r in review.reviewed(sections, spark.createDataFrame(said, "filing_id long, item_number string, provider_pos int, raw string")).collect()}
    assert got == {(1, "1"): ("reserved", "overridden: item 1 from extracted to reserved by 2 of 2"), (1, "2"): ("extracted", "unanswered: item 2"), (1, "3"): ("reserved", None), (2, "1"): ("extracted", None)}
    asked = sorted((r.item_number, r.turn, r.role, len(r.content)) for r in review.prompts(sections).collect())
    assert asked == [("1", 0, "system", len(review.INSTRUCTION)), ("1", 1, "user", 13), ("2", 0, "system", len(review.INSTRUCTION)), ("2", 1, "user", 8 + review.PROMPT_CHARS + len(review.CUT_MARK))]
    whole = results.assembled(spark.createDataFrame([(1, "a")], "filing_id long, cik string"), sections.withColumn("warning", F.when(F.col("ord") < 2, F.concat(F.lit("w"), "ord")))).first()
    assert whole.meta.warnings == ["w0", "w1"] and [x.item_number for x in whole["items"]] == ["1", "2", "3"]


def test_presentation_and_reports(spark, tmp_path):
    from tomeloom.operators import review

    one = spark.createDataFrame([(3, 1500, ["a"], None, True, False, "extracted"), (3, 0, [], None, None, True, "extracted")], "n int, ms int, w array<string>, a boolean, b boolean, era boolean, status string")
    got = one.select(review.status_line(F.col("n"), F.col("ms"), F.col("w")).alias("line"), review.is_inline_xbrl(F.col("a"), F.col("b")).alias("inline"), review.is_dimmed(F.col("era"), F.col("status")).alias("dim")).collect()
    assert [tuple(r) for r in got] == [("3 items · 1.5 s · 1 warnings", True, True), ("3 items", False, False)]
    scores = spark.createDataFrame([(2, 0.5), (1, 1.0)], "filing_id long, recall double")
    lines = [r.line for r in results.report(scores, "# T").orderBy("block", "place").collect()]
    assert lines == ["# T", "", "| filing | recall |", "| --- | --- |", "| 1 | 1.0000 |", "| 2 | 0.5000 |", "| mean | 0.7500 |"]
    results.write_report(scores, str(tmp_path / "report"), "# T")
    assert spark.read.json(str(tmp_path / "report" / "json")).count() == 2
    path = str(tmp_path / "manifest.json")
    assert src.read_or_derive(spark, path, lambda: scores).count() == 2
    with open(path, "w") as out:
        out.write('[{"slug": "a"}]')
    assert src.read_or_derive(spark, path, lambda: scores).collect()[0].slug == "a"
    held = spark.createDataFrame([("x", "1", True), ("y", "1", False), ("z", "1", False)], "file string, company string, fresh boolean")
    new = src.refreshed(held, spark.createDataFrame([("x", "2"), ("y", "2"), ("n", "2")], "file string, company string"))
    assert sorted(map(tuple, new.collect())) == [("n", "2"), ("x", "1"), ("y", "2"), ("z", "1")]
    assert src.of_source(spark.createDataFrame([("gold",), ("silver",)], "source string"), "gold").count() == 1
    failed = results.with_errors(scores, spark.createDataFrame([(9, "late")], "filing_id long, error string"))
    assert sorted(map(tuple, failed.collect()), key=repr) == [(1, 1.0, None), (2, 0.5, None), (9, 0.0, "late")]
    assert review.tallies(failed).first() == (2, 1)
