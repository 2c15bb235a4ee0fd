"""Status of a section body, cover reference, review triggers and ballots, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .. import patterns as p
from .text import first_group, has, rstrip, spans, strip

IBR = "incorporated_by_reference"


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def body_of(text: Column) -> Column:
    """The text without page footer and ``Item N.`` prefix, stripped."""
    clean = rstrip(F.regexp_replace(text, p.FOOTER, ""))
    plain = F.regexp_replace(F.replace(clean, F.lit(p.NBSP), F.lit(" ")), f"\\A{p.ANY_SPACE}+", "")
    return strip(F.regexp_replace(plain, p.ITEM_PREFIX.replace("^", "\\A", 1), ""))


def _not_applicable(body: Column) -> Column:
    return body.rlike(p.NOT_APPLICABLE) | strip(F.regexp_replace(body, p.TITLE_BEFORE_NA, "")).rlike(p.NOT_APPLICABLE)


def _by_reference(text: Column) -> Column:
    """Status by the reference clauses, null if they decide nothing."""
    return once(spans(text, p.BY_REFERENCE), lambda found: F.when(F.size(found) > 0, once(F.get(spans(text, p.WEBSITE_NOT), F.lit(0)), lambda no: _weigh(text, found, no))))


def _weigh(text: Column, found: Column, no: Column) -> Column:
    first = F.get(found, F.lit(0))
    overlap = F.least(first["end"], no["end"]) - F.greatest(first["start"], no["start"])
    covered = F.aggregate(found, F.lit(0), lambda acc, m: acc + m["end"] - m["start"])
    whole = (F.length(strip(text)) < 400) | (covered > F.length(text) * 0.30)
    status = F.when(has(text, p.REMAINING), F.lit("partial")).when(whole, F.lit(IBR)).otherwise(F.lit("partial"))
    return F.when(no.isNull() | (overlap <= 0), status)


def status_of(text: Column) -> Column:
    """One of the statuses, by the first rule that holds; null and empty texts are extracted."""

    def rules(body: Column) -> Column:
        return (
            F.when((F.length(body) < 300) & has(body, p.RESERVED), F.lit("reserved"))
            .when((F.length(body) < 250) & _not_applicable(body), F.lit("not_applicable"))
            .otherwise(F.coalesce(_by_reference(text), F.when(has(text, p.SEE_PROXY) & (F.length(text) < 600), F.lit(IBR)), F.lit("extracted")))
        )

    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("extracted")).otherwise(once(body_of(text), rules))


def cover_reference(raw_text: Column) -> Column:
    """(target_form, expected_year) of the first cover block that names a proxy, else null."""
    year = first_group(raw_text, p.COVER, 1).cast("int")
    return F.when(year.isNotNull(), F.struct(F.lit("DEF 14A").alias("target_form"), year.alias("expected_year")))


def review_reason(status: Column, text: Column) -> Column:
    """Why an extracted section should be judged again, else null."""
    t = F.coalesce(text, F.lit(""))
    # fixed values: the words of the reasons, which results are compared by
    reason = (
        F.when(F.length(t) < 500, F.concat(F.lit("short content ("), F.length(t).cast("string"), F.lit(" chars); possible missed by-reference")))
        .when(has(t, p.HINT_BY_REFERENCE), F.lit("contains 'incorporated by reference' phrase"))
        .when(has(t, p.HINT_SEE_ITEM), F.lit("contains 'see Item N' within-document cross-reference"))
        .when(has(t, p.REMAINING), F.lit("contains 'remaining/additional information by this Item' (partial signal)"))
    )
    index_row = t.rlike(f"\\A{p.ANY_SPACE}*\\[Cross-reference TOC\\]")
    return F.when((status == "extracted") & ~index_row, reason)


def ballot_status(raw: Column) -> Column:
    """The status that a ballot's text names; null for an invalid ballot."""
    text = strip(raw)
    fenced = F.regexp_replace(F.regexp_replace(text, "\\A```(?:json)?\\s*", ""), "\\s*```\\s*\\z", "")
    bare = F.when(F.startswith(text, F.lit("```")), fenced).otherwise(text)

    def parse(t: Column) -> Column:
        direct = F.try_parse_json(t)
        inner = F.try_parse_json(F.regexp_extract(t, "(?s)\\{[^{}]*\\}", 0))
        chosen = F.when(direct.isNotNull(), direct).otherwise(inner)
        named = F.when(F.schema_of_variant(F.try_variant_get(chosen, "$.status", "variant")) == "STRING", F.try_variant_get(chosen, "$.status", "string"))
        clean = F.lower(strip(named))
        return F.when(clean.isin(*dims.STATUSES), clean)

    return once(bare, parse)


def index_status(ref: Column) -> Column:
    """Status that an index row's page reference stands for."""
    s = F.lower(strip(ref))
    return (
        F.when(ref == "", F.lit("extracted"))
        .when(F.contains(s, F.lit("not applicable")) | s.isin("none", "n/a"), F.lit("not_applicable"))
        .when(s.rlike(p.INDEX_FOOTNOTE), F.lit(IBR))
        .otherwise(F.lit("extracted"))
    )
