"""The whole extraction: filings to typed, ordered, aligned sections and nested results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import status as st
from ..functions import text as tx
from ..operators import align, facts, review, segment
from ..sources import results

# Titles of rows that stand for no section of the text.
ABS_TITLE = "Asset-Backed Securities (Reg AB) filing; non-standard schema"
COVER_TITLE = "DOCUMENTS INCORPORATED BY REFERENCE (cover page)"
REFERENCE = "struct<target_form:string,expected_year:int>"


def due_items() -> Column:
    """array of (part, item_number) of the items that existed at a filing's filing_date and period_ending."""
    introduced = {n: (day, on) for n, day, on in dims.INTRODUCED}
    known = [
        F.when(F.col(introduced[n][1]) >= F.lit(introduced[n][0]).cast("date") if n in introduced else F.lit(True), F.struct(F.lit(part).alias("part"), F.lit(n).alias("item_number")))
        for n, part, _ in dims.ITEMS
    ]
    return F.array_compact(F.array(*known))


def items(filings: DataFrame, library: DataFrame | None = None, ballots: DataFrame | None = None, fuzzy: bool = False) -> DataFrame:
    """filing_id, ord, part, item_number, item_title, status, content_text, char_range_text, char_range_html, applicable_in_era, references, and with ballots warning.

    filings: filing_id, raw_text, filing_date, period_ending, and raw_html if there is one, which
    gets a cursor of its own; library: a section
    library's output, if there is one; ballots: filing_id, item_number,
    provider_pos, raw, if extracted sections with a doubt were judged again.
    """
    sources = {kind: f"raw_{kind}" for kind in ("text", "html") if f"raw_{kind}" in filings.columns}
    heads = filings.select("filing_id", *sources.values(), tx.looks_asset_backed(F.col("raw_text")).alias("is_abs"), st.cover_reference(F.col("raw_text")).alias("cover"), F.transform(due_items(), lambda x: x["item_number"]).alias("due"))
    keep, plain = (*sources.values(), "cover", "due"), heads.where("NOT is_abs")
    if library is None:
        found = segment.chosen(plain, *keep)
    else:
        found = segment.merged(segment.library_sections(library), segment.chosen(filings), heads.select("filing_id", "is_abs")).join(plain.select("filing_id", *keep), "filing_id")
    # a filing's sections are ordered and placed within its row; what nobody reads of that is not computed
    found = segment.held(found, "sections", segment.in_document_order(F.col("sections")))
    ranges = {f"char_range_{kind}": align.exact_ranges(F.col("sections"), F.col(source)) for kind, source in sources.items() if kind == "html" or not fuzzy}
    rows = found.select("filing_id", "cover", "due", "sections", *[x.alias(name) for name, x in ranges.items()]).select("filing_id", "cover", "due", *ranges, F.explode("sections").alias("s")).select("filing_id", "cover", "due", *ranges, "s.*")
    for name in ranges:
        rows = rows.withColumn(name, F.get(name, F.col("ord"))["range"])
    rows = rows.withColumn("status", F.coalesce(F.nullif("status_hint", F.lit("")), st.status_of(F.col("content_text"))))
    if ballots is not None:
        rows = review.reviewed(rows, ballots)
    if fuzzy:
        places = align.align_fuzzy(rows.select("filing_id", "ord", "item_number", "content_text"), filings)
        rows = rows.join(places.select("filing_id", "ord", F.col("range").alias("char_range_text")), ["filing_id", "ord"], "left")
    if "html" not in sources:
        rows = rows.withColumn("char_range_html", F.lit(None).cast(align.RANGE))
    refers = F.when(F.col("status").isin(st.IBR, "partial"), F.col("cover"))
    told = ["warning"] if ballots is not None else []
    out = rows.select("filing_id", "ord", "part", "item_number", "item_title", "status", "content_text", "char_range_text", "char_range_html", F.array_contains("due", F.col("item_number")).alias("applicable_in_era"), refers.alias("references"), *told)

    def made(only: Column, order: int, number: str, title: str, status: str, applicable: bool, ref: Column) -> DataFrame:
        return heads.where(only).select(
            "filing_id", F.lit(order).alias("ord"), F.lit(0).alias("part"), F.lit(number).alias("item_number"), F.lit(title).alias("item_title"), F.lit(status).alias("status"), F.lit("").alias("content_text"),
            F.lit(None).cast(align.RANGE).alias("char_range_text"), F.lit(None).cast(align.RANGE).alias("char_range_html"), F.lit(applicable).alias("applicable_in_era"), ref.alias("references"), *[F.lit(None).cast("string").alias(x) for x in told],
        )

    placeholder = made(F.col("is_abs"), 0, "abs", ABS_TITLE, "non_standard", False, F.lit(None).cast(REFERENCE))
    cover = made(F.col("cover").isNotNull(), -1, "cover", COVER_TITLE, st.IBR, True, F.col("cover"))
    return out.unionByName(placeholder).unionByName(cover)


def extract(filings: DataFrame, library: DataFrame | None = None, ballots: DataFrame | None = None, companies: DataFrame | None = None) -> DataFrame:
    """One nested result a filing: filing, items, meta, xbrl_validation (with companies: filing_id, accession, company)."""
    rows = items(filings, library, ballots)
    validation = None
    if companies is not None:
        heads = filings.select("filing_id", "accession", F.date_format("period_ending", "yyyy-MM-dd").alias("period_ending")).join(companies.select("filing_id", F.lit(True).alias("has_company")), "filing_id", "left")
        validation = facts.report(heads.withColumn("has_company", F.coalesce("has_company", F.lit(False))), facts.unnested(companies), rows)
    return results.assembled(filings, rows, validation)
