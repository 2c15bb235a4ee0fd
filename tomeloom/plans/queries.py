"""Every operator of the filing engine as a registered query.

Filings are made from the documents table (see ``corpus``); facts from orders,
requests from events, ballots and expectations by arithmetic on ids, so that
every query reads whole tables and has an SQL counterpart in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from .. import patterns as p
from ..functions import status as st
from ..functions import text as tx
from ..operators import align, evaluate, facts, limits, review, segment, votes
from ..sources import filings as src
from ..sources import results
from ..streaming import limiter
from .corpus import KEYED, LABELLED, filings, pieces
from .extract import due_items, extract, items

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PROVIDERS = 3


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(*names: str) -> list[Column]:
    return [c(n).cast("long").alias(n) for n in names]


# --- segmentation


@query
def heading_spans(spark, sf_dir):
    return segment.heading_spans(filings(spark, sf_dir)).select("filing_id", *big("start", "end"), "item_number", "title")


@query
def best_heading_per_item(spark, sf_dir):
    return segment.best_headings(segment.heading_spans(filings(spark, sf_dir))).select("filing_id", "item_number", *big("start", "room"))


SECTION_OUT = ("filing_id", "item_number", "item_title", "content_text")


@query
def section_slices(spark, sf_dir):
    return segment.heading_sections(filings(spark, sf_dir)).select(*big("ord", "part"), *SECTION_OUT)


@query
def title_sections(spark, sf_dir):
    return segment.title_sections(filings(spark, sf_dir)).select(*big("ord", "part"), *SECTION_OUT)


@query
def index_table_sections(spark, sf_dir):
    return segment.index_sections(filings(spark, sf_dir)).select(*big("ord", "part"), *SECTION_OUT, "status_hint")


@query
def segment_strategy(spark, sf_dir):
    rows = segment.chosen(filings(spark, sf_dir))
    return rows.select("filing_id", F.get("sections", F.lit(0))["source"].alias("source"), F.size("sections").cast("long").alias("n"))


@query
def coverage_suspect(spark, sf_dir):
    return segment.suspect_coverage(segment.heading_sections(filings(spark, sf_dir))).select("filing_id", *big("n"), "suspect")


def library(spark, sf_dir) -> DataFrame:
    """A section library's output: keyed and labelled sections, each set of them with the whole text dealt over it."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    entry = lambda key, text: F.struct(F.lit(key).alias("key"), text.alias("text"))
    keyed, labelled = [], []
    for no, (number, part, title) in enumerate(dims.ITEMS):
        body = lambda holds: F.concat(F.lit(f"Item {number}.  {title}  "), F.expr(pieces(holds, no)), F.when((c("doc_id") + no) % 6 == 0, F.lit(" Item 99. Bleeds in.")).otherwise(F.lit("")))  # noqa: B023, E731
        roman = ("i", "ii", "iii", "iv")[part - 1]
        keyed.append(F.when((c("doc_id") + no) % 3 == 0, entry(f"part_{roman}_item_{number.lower()}", body(KEYED))))
        labelled.append(F.when((c("doc_id") + no) % 4 <= 1, entry(f"Item {number}", body(LABELLED))))
    return docs.select(c("doc_id").alias("filing_id"), F.array_compact(F.array(*keyed)).alias("keyed"), F.array_compact(F.array(*labelled)).alias("labelled"))


@query
def library_sections_merge(spark, sf_dir):
    """Library sections, unless the filing's own text yields strictly more."""
    f = filings(spark, sf_dir)
    flagged = f.select("filing_id", tx.looks_asset_backed(c("raw_text")).alias("is_abs"))
    merged = segment.merged_sections(segment.library_sections(library(spark, sf_dir)), segment.chosen(f), flagged)
    return merged.select("filing_id", "source", *big("part"), "item_number", F.length("content_text").cast("long").alias("n_chars"))


@query
def bleed_trim(spark, sf_dir):
    """Library texts cut where the next section begins."""
    rows = library(spark, sf_dir).select("filing_id", F.explode("keyed").alias("s")).select("filing_id", "s.key", F.explode(F.array(c("s.text"))).alias("text"))
    return segment.held(rows, "text", tx.strip(c("text"))).select("filing_id", "key", tx.bleed_trimmed(c("text")).alias("content_text"))


@query
def section_titles(spark, sf_dir):
    rows = library(spark, sf_dir).select("filing_id", F.explode("labelled").alias("s"))
    number = F.upper(F.regexp_extract("s.key", p.ITEM_LABEL, 1))
    return rows.select("filing_id", number.alias("item_number"), tx.section_title(c("s.text"), number).alias("title"))


@query
def abs_filings(spark, sf_dir):
    """Asset-backed filings get one placeholder section."""
    f = filings(spark, sf_dir).where(tx.looks_asset_backed(c("raw_text")))
    return f.select("filing_id", F.lit(0).cast("long").alias("part"), F.lit("abs").alias("item_number"), F.lit("non_standard").alias("status"), F.lit(False).alias("applicable_in_era"))


# --- status, cover, era


def classified(spark, sf_dir) -> DataFrame:
    rows = segment.heading_sections(filings(spark, sf_dir))
    rows = rows.withColumn("content_text", F.explode(F.array("content_text")))  # computed once, used often
    return rows.withColumn("status", F.coalesce(F.nullif("status_hint", F.lit("")), st.status_of(c("content_text"))))


@query
def status_by_item(spark, sf_dir):
    return classified(spark, sf_dir).select("filing_id", "item_number", "status")


@query
def status_distribution(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("filing_id", "status").agg(F.count("*").alias("n"))


@query
def cover_reference(spark, sf_dir):
    """The cover's reference on the sections that refer elsewhere."""
    ref = filings(spark, sf_dir).select("filing_id", st.cover_reference(c("raw_text")).alias("ref")).where("ref IS NOT NULL")
    rows = classified(spark, sf_dir).select("filing_id", "item_number", "status").join(ref, "filing_id", "left")
    on = c("status").isin(st.IBR, "partial")
    return rows.select("filing_id", "item_number", F.when(on, c("ref.target_form")).alias("target_form"), F.when(on, c("ref.expected_year")).cast("long").alias("expected_year"))


def applicable(f: DataFrame) -> DataFrame:
    """filing_id, part, item_number of the items that the filing's dates call for."""
    return f.select("filing_id", F.explode(due_items()).alias("i")).select("filing_id", c("i.part").cast("long").alias("part"), "i.item_number")


def dated(spark, sf_dir) -> DataFrame:
    return filings(spark, sf_dir).select("filing_id", "filing_date", "period_ending")


@query
def era_applicability(spark, sf_dir):
    """Sections with whether their item existed at the filing's dates."""
    rows = segment.best_headings(segment.heading_spans(filings(spark, sf_dir))).select("filing_id", "item_number")
    flags = applicable(dated(spark, sf_dir)).select("filing_id", "item_number", F.lit(True).alias("on"))
    return rows.join(flags, ["filing_id", "item_number"], "left").select("filing_id", "item_number", tx.part_of(c("item_number")).cast("long").alias("part"), c("on").isNotNull().alias("applicable_in_era"))


@query
def era_gaps(spark, sf_dir):
    """Items that are missing or unexpected for the filing's dates, in order of their text."""
    found = segment.best_headings(segment.heading_spans(filings(spark, sf_dir))).groupBy("filing_id").agg(F.collect_set("item_number").alias("found"))
    due = applicable(dated(spark, sf_dir)).groupBy("filing_id").agg(F.collect_set("item_number").alias("due"))
    rows = due.join(found, "filing_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    listed = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return rows.select("filing_id", listed("due", "found").alias("missing"), listed("found", "due").alias("unexpected"))


@query
def document_order(spark, sf_dir):
    """Library sections in document order, behind a cover row where the cover names a proxy."""
    f = filings(spark, sf_dir)
    rows = segment.document_order(segment.library_sections(library(spark, sf_dir))).select("filing_id", "ord", "item_number")
    cover = f.where(st.cover_reference(c("raw_text")).isNotNull()).select("filing_id", F.lit(-1).alias("ord"), F.lit("cover").alias("item_number"))
    return cover.unionByName(rows).select("filing_id", *big("ord"), "item_number")


# --- alignment


@query
def align_exact(spark, sf_dir):
    """Every place of every whole benchmark passage in every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.passages(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query
def align_cursor(spark, sf_dir):
    f = filings(spark, sf_dir)
    return align.align_exact(segment.heading_sections(f), f).select("filing_id", "item_number", *big("ord"), c("range.start").cast("long").alias("start"), c("range.end").cast("long").alias("end"))


@query
def align_html(spark, sf_dir):
    """The sections' places in the markup of the filings that have any, along a cursor of its own."""
    f = filings(spark, sf_dir)
    html = f.where("filing_id % 3 <> 0").select("filing_id", F.concat(F.lit("<html><body>"), F.replace("raw_text", F.lit("\n"), F.lit("<br>\n")), F.lit("</body></html>")).alias("raw_text"))
    return align.align_exact(segment.heading_sections(f), html).select("filing_id", "item_number", *big("ord"), c("range.start").cast("long").alias("start"), c("range.end").cast("long").alias("end"))


@query
def align_fuzzy(spark, sf_dir):
    """Sections whose blanks were doubled, found by longest block or but for white space."""
    f = filings(spark, sf_dir)
    blurred = segment.heading_sections(f).withColumn("content_text", F.regexp_replace("content_text", "([a-z]) ([A-Z])", "$1  $2"))
    return align.align_fuzzy(blurred, f).select("filing_id", "item_number", *big("ord"), c("range.start").cast("long").alias("start"), c("range.end").cast("long").alias("end"))


@query
def span_iou(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    i = c("doc_id")
    a0, a1, b0 = i % 50, i % 50 + i % 13, i % 37
    b1 = F.when(i % 11 == 0, F.lit(None)).otherwise(i % 37 + i % 17 - F.when(i % 19 == 0, 30).otherwise(0))
    return docs.select("doc_id", align.span_iou(a0, a1, b0, b1).alias("iou")).groupBy((c("doc_id") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(c("iou") > 0).alias("overlapping"), F.count_if(c("iou") == 1).alias("equal"), F.round(F.coalesce(F.avg("iou"), F.lit(0.0)), 6).alias("mean_iou"))


# --- facts


def companies(spark, sf_dir) -> DataFrame:
    """Company facts as JSON text, one company a customer with orders."""
    o = table(spark, sf_dir, "orders")
    fact = F.to_json(F.struct(
        c("o_totalprice").alias("val"), F.when(c("o_orderkey") % 3 == 0, F.lit("other")).otherwise(F.concat(F.lit("acc-"), c("o_custkey"))).alias("accn"), F.year("o_orderdate").alias("fy"),
        F.when(c("o_orderkey") % 2 == 0, F.lit("FY")).otherwise(F.lit("Q1")).alias("fp"), F.lit("10-K").alias("form"),
    ))
    concept = F.element_at(F.array(*[F.lit(x) for x in ("Revenues", "NetIncomeLoss", "Assets", "SalesRevenueNet")]), (c("o_orderkey") % 4 + 1).cast("int"))
    per = o.groupBy("o_custkey", concept.alias("concept")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", fact.alias("f")))).alias("fs"))
    body = F.concat(F.lit('"'), c("concept"), F.lit('":{"units":{"USD":['), F.array_join(F.transform("fs", lambda x: x["f"]), ","), F.lit("]}}"))
    doc = per.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("concept", body.alias("b")))), lambda x: x["b"]), ",").alias("b"))
    return doc.select(c("o_custkey").alias("filing_id"), F.concat(F.lit("acc-"), c("o_custkey")).alias("accession"), F.concat(F.lit('{"cik":'), c("o_custkey"), F.lit(',"facts":{"us-gaap":{'), c("b"), F.lit("}}}")).alias("company"))


@query
def facts_unnest(spark, sf_dir):
    return facts.unnested(companies(spark, sf_dir)).select("filing_id", "concept", "unit", *big("concept_pos", "fact_pos", "fy"), "fp", "val")


def fiscal_years(spark, sf_dir) -> DataFrame:
    return companies(spark, sf_dir).select("filing_id", (F.lit(1992) + c("filing_id") % 7).cast("int").alias("fiscal_year"))


@query
def fiscal_pick(spark, sf_dir):
    return facts.picked(facts.unnested(companies(spark, sf_dir)), fiscal_years(spark, sf_dir)).select("filing_id", "concept_group", "concept", *big("fy"), "fp", "val")


def order_text(value: Column, key: Column) -> Column:
    """A sentence that holds the value in one of several forms, or not."""
    return (
        F.when(key % 5 == 0, F.concat(F.lit("total of $"), F.format_number(F.rint(value), 0)))
        .when(key % 5 == 1, F.concat(F.lit("about $"), F.format_number(value / 1000, 1), F.lit(" thousand")))
        .when(key % 5 == 2, F.concat(F.lit("some $"), F.format_number(value / 1000000, 2), F.lit(" million")))
        .when(key % 5 == 3, F.lit("no number here"))
        .otherwise(F.concat(F.lit("$"), F.format_number(value / 1000, 0), F.lit(" K")))
    )


@query
def value_in_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.explode(F.array(order_text(c("o_totalprice"), c("o_orderkey")))).alias("text"))
    return o.select("o_orderkey", facts.match_form(c("o_totalprice"), c("text")).alias("match_form"))


@query
def facts_report(spark, sf_dir):
    """Validation of every company's filing against a section that quotes its highest value."""
    comp = companies(spark, sf_dir)
    rows = facts.unnested(comp)
    i = c("filing_id")
    heads = comp.select("filing_id", "accession", F.concat((F.lit(1992) + i % 7).cast("string"), F.lit("-12-31")).alias("period_ending"), (i % 9 != 0).alias("has_company"))
    status = F.when(i % 3 == 0, F.lit("incorporated_by_reference")).otherwise(F.lit("extracted"))
    top = rows.groupBy("filing_id").agg(F.max("val").alias("top"))
    items = top.select("filing_id", F.lit(11).alias("ord"), F.lit("8").alias("item_number"), status.alias("status"), F.concat(F.lit("Values of "), F.format_number(F.rint("top"), 0), F.lit(" were reported.")).alias("content_text"))
    r = facts.report(heads, rows, items)
    checks = c("numeric_reconciliations")
    return r.select("filing_id", "has_xbrl_data", *big("total_facts"), "item_8_status_consistent", "period_aligned", F.size(checks).cast("long").alias("n_checks"), F.size(F.filter(checks, lambda x: x["found_in_item8"])).cast("long").alias("n_found"), F.size("warnings").cast("long").alias("n_warnings"))


# --- review and votes


@query
def augment_trigger(spark, sf_dir):
    rows = classified(spark, sf_dir)
    return rows.select("filing_id", "item_number", st.review_reason(c("status"), c("content_text")).alias("reason"))


def ballots(spark, sf_dir) -> DataFrame:
    """Three voters' raw answers on every labelled document: plain, fenced, in prose, broken or unknown."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(PROVIDERS)])).alias("provider_pos"))
    k = c("doc_id") + c("provider_pos")
    name = F.element_at(F.array(*[F.lit(s) for s in dims.STATUSES]), ((c("doc_id") * 7 + c("provider_pos") * (c("doc_id") % 3)) % 6 + 1).cast("int"))
    obj = F.concat(F.lit('{"status": "'), F.when(k % 4 == 0, F.upper(name)).otherwise(name), F.lit('"}'))
    raw = (
        F.when(k % 7 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(k % 7 == 1, F.concat(F.lit("The answer is "), obj, F.lit(" as asked.")))
        .when(k % 7 == 2, F.lit("no idea"))
        .when(k % 7 == 3, F.lit('{"status": "unheard of"}'))
        .when(k % 7 == 4, F.lit('{"status": 5}'))
        .otherwise(obj)
    )
    return rows.select(c("doc_id").alias("filing_id"), F.lit("7").alias("item_number"), "provider_pos", raw.alias("raw"))


def votes_cast(spark, sf_dir) -> DataFrame:
    return ballots(spark, sf_dir).withColumn("value", st.ballot_status(c("raw")))


@query
def ballot_parse(spark, sf_dir):
    return votes_cast(spark, sf_dir).select("filing_id", *big("provider_pos"), "value")


def asked(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(c("doc_id").alias("filing_id")).distinct()
    return rows.select("filing_id", F.lit("7").alias("item_number"), F.when(c("filing_id") % 5 != 0, F.lit("extracted")).alias("fallback"))


@query
def vote_majority(spark, sf_dir):
    return votes.tally(votes_cast(spark, sf_dir), asked(spark, sf_dir)).select("filing_id", "pick", *big("n_top", "n_votes"), "fallback_used")


@query
def vote_override(spark, sf_dir):
    items = asked(spark, sf_dir).select("filing_id", "item_number", F.lit("extracted").alias("status"))
    won = votes.tally(votes_cast(spark, sf_dir), items.withColumnRenamed("status", "fallback"))
    return votes.overridden(won, items).select("filing_id", "status", "old_status", "overridden")


# --- evaluation


def labelled_items(spark, sf_dir, shift: int) -> DataFrame:
    """Items and statuses by arithmetic on the labels, so that two shifts agree in part."""
    rows = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL")
    k = c("doc_id")
    made = [F.when((k * 3 + no + shift) % 5 != 0, F.struct(F.lit(no).alias("ord"), F.lit(n if no % 2 else n.lower()).alias("item_number"), F.element_at(F.array(*[F.lit(s) for s in dims.STATUSES]), ((k + no + (F.when(k % 4 == 0, shift).otherwise(0))) % 6 + 1).cast("int")).alias("status"))) for no, (n, _, _) in enumerate(dims.ITEMS)]
    made.append(F.struct(F.lit(-1).alias("ord"), F.lit("cover").alias("item_number"), F.lit("incorporated_by_reference").alias("status")))
    return rows.select(c("doc_id").alias("filing_id"), F.explode(F.array_compact(F.array(*made))).alias("x")).select("filing_id", "x.*")


def counts(spark, sf_dir) -> DataFrame:
    return evaluate.scores(labelled_items(spark, sf_dir, 1), labelled_items(spark, sf_dir, 0))


@query
def gold_scores(spark, sf_dir):
    names = ("items_actual", "items_expected", "tp", "fp", "fn", "status_correct", "pairs_correct", "pairs_expected")
    return counts(spark, sf_dir).select("filing_id", *big(*names), "fp_items", "fn_items", "mismatches")


@query
def gold_means(spark, sf_dir):
    """Macro means over filings."""
    r = evaluate.ratios(counts(spark, sf_dir))
    return r.agg(F.count("*").alias("filings"), *[F.round(F.avg(n), 6).alias(n) for n in ("item_recall", "item_precision", "status_accuracy", "full_match_rate")])


@query
def constraint_violations(spark, sf_dir):
    got = labelled_items(spark, sf_dir, 1)
    k = c("filing_id")
    asked_of = got.select("filing_id").distinct().select(
        "filing_id", F.when(k % 2 == 0, 19).alias("min_items"), F.when(k % 3 == 0, 17).alias("max_items"), F.array(F.lit("1C"), F.lit("9C")).alias("must_not_have"),
        F.create_map(F.lit("10"), F.array(F.lit("extracted"), F.lit("partial")), F.lit("7A"), F.array(F.lit("reserved"))).alias("must_have_status"), (k % 10 == 0).alias("is_abs"),
    )
    return evaluate.violations(got, asked_of).select("filing_id", F.array_join("violations", "; ").alias("violations"))


# --- state


def requests(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(c("user_id").alias("key"), F.unix_micros(c("ts").cast("timestamp")).alias("ts"), "event_id")


RATE = 0.005  # tokens a minute: events of one key are hours apart


@query
def token_bucket(spark, sf_dir):
    return limits.allowances(requests(spark, sf_dir), 3, RATE).select("key", "event_id", "allowed")


@query
def token_bucket_stream(spark, sf_dir):
    """The same over a stream of files, one trigger for what is there."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = rows.select(c("user_id").alias("key"), F.unix_micros(c("ts").cast("timestamp")).alias("ts"), "event_id")
    return limiter.collected(limiter.stream_allowances(rows, 3, RATE)).select("key", "event_id", "allowed")


@query
def lru_evict(spark, sf_dir):
    """Keys that stay when the buckets are full; a bucket count of 64 makes every scale evict."""
    last = requests(spark, sf_dir).groupBy("key").agg(F.max("ts").alias("last"))
    return limits.kept_buckets(last, 64).select("key", "last")


@query
def ttl_fresh(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return e.select("event_id", src.is_fresh(c("ts"), now).alias("fresh")).groupBy("fresh").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query
def backoff_schedule(spark, sf_dir):
    """Delays by region key as the base."""
    r = table(spark, sf_dir, "region")
    d = limits.backoff(1.0, 10.0, 7)
    return r.select(c("r_regionkey").cast("long").alias("region"), F.posexplode(d).alias("attempt", "delay")).select("region", *big("attempt"), (c("delay") * (c("region") + 1)).alias("delay"))


@query
def transient_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    k = c("event_id") % 9
    said = F.element_at(F.array(*[F.lit(x) for x in ("HTTP 429", "Too Many Requests", "502 Bad Gateway", "code: 503", "status_code=504", "5028 items", "read TimeOut", "timed out", "broken")]), (k + 1).cast("int"))
    code = F.when(c("event_id") % 50 == 8, F.lit(503))
    return e.select("event_id", limits.is_rate_limit(said, code).alias("rate_limit"), limits.is_transient(said, code).alias("transient"))


# --- requests, catalogue, presentation


@query
def request_validation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = c("o_orderkey")
    cik = F.when(k % 4 == 0, F.concat(F.lit("x"), k)).otherwise(F.lpad((k % 100000).cast("string"), 10, "0"))
    accession = F.concat(F.lpad(k.cast("string"), F.when(k % 5 == 0, 9).otherwise(10), F.lit("0")), F.lit("-24-000001"))
    forwarded = F.when(k % 3 == 0, F.concat(F.lit(" 10.0.0."), k % 256, F.lit(" , 10.1.1.1"))).when(k % 3 == 1, F.lit(""))
    host = F.when(k % 2 == 0, F.lit("192.0.2.1"))
    ip = F.when(forwarded != "", F.trim(F.get(F.split(forwarded, ","), F.lit(0)))).otherwise(F.coalesce(host, F.lit("unknown")))
    ok = cik.rlike(p.CIK)
    message = F.concat(F.lit("failed\n"), F.repeat(F.lit("ab "), (k % 100).cast("int")))
    return o.select(k.alias("o_orderkey"), ok.alias("cik_ok"), accession.rlike(p.ACCESSION).alias("accession_ok"), F.when(ok, cik.try_cast("long").cast("string")).alias("cik"), F.when(ok, src.facts_file(cik.try_cast("long"))).alias("facts_file"), ip.alias("client_ip"), tx.shorten(message).alias("message"))


@query
def catalogue_merge(spark, sf_dir):
    """Gold and silver catalogues with labels and defaults; only annual reports."""
    d, l = filings(spark, sf_dir).drop("raw_text"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    rows = src.annual_reports(d).withColumn("slug", F.concat(F.lit("f-"), c("filing_id"))).select("filing_id", "slug", "cik", "accession", F.when(c("filing_id") % 3 != 0, c("form_type")).alias("form_type"), F.date_format("period_ending", "yyyy-MM-dd").alias("period_ending"), F.when(c("filing_id") % 2 == 0, F.lit("even")).alias("comment"))
    known = rows.join(l.withColumnRenamed("doc_id", "filing_id"), "filing_id", "left_semi")
    other = rows.join(l.withColumnRenamed("doc_id", "filing_id"), "filing_id", "left_anti")
    merged = src.catalogue(known, other, {"f-0": "First filing", "f-1": "Second filing", "f-4": "Fifth filing"}, {"f-0": "a note", "f-9": "another note"})
    return merged.select(*big("ord"), "slug", "label", "cik", "accession", "form_type", "period_ending", "characteristic", "source")


@query
def parts_grouped(spark, sf_dir):
    """Sections of each part with their texts' excerpts, as a page shows them."""
    rows = classified(spark, sf_dir)
    shown = rows.select("filing_id", "part", "ord", F.concat_ws("|", "item_number", "status", tx.escape_html(F.substring("item_title", 1, 40)), tx.excerpt(c("content_text"), 150)["truncated"].cast("string")).alias("line"))
    one = shown.groupBy("filing_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), ";").alias("lines"), F.count("*").alias("n"))
    return one.select("filing_id", tx.roman(c("part")).alias("part"), "n", "lines")


@query
def date_coercion(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = c("o_orderkey")
    text = F.when(k % 7 != 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 2 == 0, F.lit("T00:00:00")).otherwise(F.lit(""))))
    day = F.coalesce(F.to_date(F.substring(text, 1, 10)), F.lit("1900-01-01").cast("date"))
    year = F.when(F.length(text) >= 4, F.substring(text, 1, 4).try_cast("int"))
    return o.select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"), F.coalesce(F.substring(text, 1, 10), F.lit("")).alias("shown"), year.cast("long").alias("fiscal_year"))


@query
def conversation_turns(spark, sf_dir):
    """First and last turn, and the longest wait between a user's turns, of every conversation."""
    t = table(spark, sf_dir, "conversations")
    gap = c("turn") - F.lag("turn").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    g = t.withColumn("gap", gap).groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.max("gap").alias("widest_gap"))
    return g.select("conv_id", "turns", "first_role", "last_role", "widest_gap")


@query
def page_headings(spark, sf_dir):
    """Headings in markup of every page, with their places."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(tx.spans(F.coalesce("html", F.lit("")), "(?s)<h1>.*?</h1>")).alias("m"))
    return rows.select("page_id", c("m.start").cast("long").alias("start"), F.regexp_replace("m.hit", "</?h1>", "").alias("heading"))


@query
def extraction(spark, sf_dir):
    """The whole extraction: sections by the strategy that fits, typed and flagged, behind cover and placeholder rows."""
    rows = items(filings(spark, sf_dir))
    return rows.select("filing_id", *big("ord", "part"), "item_number", "status", "applicable_in_era", c("references.expected_year").cast("long").alias("expected_year"))


@query
def extraction_documents(spark, sf_dir):
    """The nested results, reduced to what each holds."""
    docs = extract(filings(spark, sf_dir), library(spark, sf_dir))
    return docs.select("filing_id", F.size("items").cast("long").alias("items"), F.size(F.filter("items", lambda x: x["char_range_text"].isNotNull())).cast("long").alias("aligned"), F.length(F.to_json("items")).cast("long").alias("json_chars"))


def section_ballots(spark, sf_dir) -> DataFrame:
    """Three voters' answers on some items of every filing, by arithmetic on the id."""
    rows = filings(spark, sf_dir).select("filing_id", F.explode(F.array(*[F.lit(n) for n in ("1A", "7", "8", "10")])).alias("item_number")).select("*", F.explode(F.array(*[F.lit(i) for i in range(PROVIDERS)])).alias("provider_pos"))
    k = c("filing_id") + F.length("item_number") * 5 + F.when(c("filing_id") % 2 == 0, 0).otherwise(c("provider_pos"))
    name = F.element_at(F.array(*[F.lit(x) for x in dims.STATUSES]), (k % 6 + 1).cast("int"))
    return rows.select("filing_id", "item_number", "provider_pos", F.when(k % 11 == 0, F.lit("no idea")).otherwise(F.concat(F.lit('{"status": "'), name, F.lit('"}'))).alias("raw"))


@query
def reviewed_statuses(spark, sf_dir):
    """Statuses after the votes on doubtful sections, and what the votes did."""
    return review.reviewed(classified(spark, sf_dir), section_ballots(spark, sf_dir)).select("filing_id", "item_number", "status", "warning")


@query
def review_prompts(spark, sf_dir):
    return review.prompts(classified(spark, sf_dir)).select("filing_id", "item_number", *big("turn"), "role", "content")


@query
def alignment_rates(spark, sf_dir):
    """Items and the share of them that have a place in the text, of every filing."""
    return review.alignment_rates(align_cursor(spark, sf_dir)).select("filing_id", "items", F.round("text_rate", 6).alias("text_rate"))


@query
def item_details(spark, sf_dir):
    """The first row of every item with its dim flag."""
    return review.item_details(items(filings(spark, sf_dir))).select("filing_id", "item_number", *big("ord"), "status", "dimmed")


def _ratios_with_errors(spark, sf_dir) -> DataFrame:
    failed = table(spark, sf_dir, "documents").where("doc_id % 17 = 3").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return results.with_errors(evaluate.ratios(counts(spark, sf_dir)), failed.select(c("doc_id").alias("filing_id"), F.lit("not labelled").alias("error")))


@query
def scores_with_errors(spark, sf_dir):
    """Ratios of every scored filing, and failed ones as zeros that name the error."""
    names = ("item_recall", "item_precision", "status_accuracy", "full_match_rate")
    return _ratios_with_errors(spark, sf_dir).select("filing_id", *[F.round(n, 6).alias(n) for n in names], "error")


@query
def result_tallies(spark, sf_dir):
    return review.tallies(_ratios_with_errors(spark, sf_dir))


@query
def score_report(spark, sf_dir):
    """The lines of the report on the scores."""
    lines = results.report(evaluate.ratios(counts(spark, sf_dir)).select("filing_id", "item_recall", "item_precision"), "# Scores")
    return lines.select(*big("block", "place"), "line")


@query
def flagship(spark, sf_dir):
    """How many sections of each status the filings hold, and how long they are."""
    return classified(spark, sf_dir).groupBy("status").agg(F.count("*").alias("sections"), F.count_distinct("filing_id").alias("filings"), F.sum(F.length("content_text").cast("long")).alias("n_chars"))
