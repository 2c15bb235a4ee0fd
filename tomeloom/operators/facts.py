"""Reported facts against sections: unnesting, choice by fiscal year, and values in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims

FACT = "struct<start:string,`end`:string,val:double,accn:string,fy:int,fp:string,form:string>"
COMPANY = f"struct<cik:bigint,entityName:string,facts:map<string,map<string,struct<label:string,units:map<string,array<{FACT}>>>>>>"


def unnested(companies: DataFrame) -> DataFrame:
    """One row per us-gaap fact with the places of concept, unit and fact; companies: filing_id, accession, company (JSON text).

    Facts of other accessions are dropped inside the arrays, before the rows are made.
    """
    parsed = companies.select("filing_id", "accession", F.from_json("company", COMPANY).alias("c"))
    concepts = parsed.select("filing_id", "accession", F.posexplode(F.try_element_at("c.facts", F.lit("us-gaap"))).alias("concept_pos", "concept", "data"))
    units = concepts.select("filing_id", "accession", "concept_pos", "concept", F.posexplode("data.units").alias("unit_pos", "unit", "facts"))
    own = F.filter(F.transform("facts", lambda f, i: F.struct(i.alias("pos"), f.alias("f"))), lambda x: x["f"]["accn"] == F.col("accession"))
    rows = units.withColumn("facts", own).where(F.size("facts") > 0).select("filing_id", "accession", "concept_pos", "concept", "unit_pos", "unit", F.explode("facts").alias("x"))
    return rows.select("filing_id", "accession", "concept_pos", "concept", "unit_pos", "unit", F.col("x.pos").alias("fact_pos"), "x.f.*")


def picked(facts: DataFrame, fiscal_years: DataFrame) -> DataFrame:
    """Per filing and concept group the fact to reconcile.

    The first concept that has any fact; of its facts one for the whole fiscal
    year asked for, else any whole year, else the first.
    """
    groups = [(g, no, c) for g, concepts in dims.CONCEPT_GROUPS for no, c in enumerate(concepts)]
    lookup = F.broadcast(facts.sparkSession.createDataFrame(groups, "concept_group string, preference int, concept string"))  # a constant of six rows
    rows = facts.join(lookup, "concept").join(fiscal_years, "filing_id", "left")
    rank = F.when((F.col("fp") == "FY") & (F.col("fy") == F.col("fiscal_year")), 0).when(F.col("fp") == "FY", 1).otherwise(2)
    order = Window.partitionBy("filing_id", "concept_group").orderBy("preference", rank, "unit_pos", "fact_pos")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("filing_id", "concept_group", "concept", "unit", "val", "fy", "fp")


def representations(value: Column) -> Column:
    """array of (form, rep) of the ways that a value is written, in the order in which they are tried."""
    size = F.abs(value)
    tries = [F.struct(F.lit("exact").alias("form"), F.format_number(F.rint(size), 0).alias("rep"), F.lit(True).alias("on"))]
    for scale, form in dims.SCALES:
        tries += [F.struct(F.lit(form).alias("form"), F.format_number(size / scale, d).alias("rep"), (size / scale >= 0.1).alias("on")) for d in dims.DECIMALS]
    return F.filter(F.array(*tries), lambda t: t["on"])


def match_form(value: Column, text: Column) -> Column:
    """How the value stands in the text: exact, thousands, millions, billions, or null.  Plain substrings count."""
    hits = F.filter(representations(value), lambda t: F.contains(text, t["rep"]))
    return F.when(value != 0, F.get(hits, F.lit(0))["form"])


def report(filings: DataFrame, facts: DataFrame, sections: DataFrame) -> DataFrame:
    """One validation row per filing; filings: filing_id, accession, period_ending (text), has_company."""
    year = F.when(F.length("period_ending") >= 4, F.substring("period_ending", 1, 4).try_cast("int"))
    base = filings.select("filing_id", "accession", "period_ending", "has_company", year.alias("fiscal_year"))
    counts = facts.groupBy("filing_id").agg(F.count("*").alias("total_facts"), F.min_by("fy", F.struct("concept_pos", "unit_pos", "fact_pos")).alias("first_fy"))
    item8 = sections.where("item_number = '8'").groupBy("filing_id").agg(F.min_by(F.struct("status", "content_text"), "ord").alias("item8"))
    chosen = picked(facts, base.select("filing_id", "fiscal_year")).where("val IS NOT NULL").join(item8, "filing_id", "left")
    form = F.when(F.coalesce("item8.content_text", F.lit("")) != "", match_form(F.col("val"), F.col("item8.content_text")))
    place = F.element_at(F.create_map(*[F.lit(x) for i, (g, _) in enumerate(dims.CONCEPT_GROUPS) for x in (g, i)]), F.col("concept_group"))
    row = F.struct(place.alias("k"), "concept", F.col("val").alias("xbrl_value"), "unit", F.col("fy").alias("fiscal_year"), form.isNotNull().alias("found_in_item8"), form.alias("match_form"))
    checks = chosen.select("filing_id", row.alias("r")).groupBy("filing_id").agg(F.array_sort(F.collect_list("r")).alias("checks"))
    joined = base.join(counts, "filing_id", "left").join(item8, "filing_id", "left").join(checks, "filing_id", "left")
    n, status = F.coalesce("total_facts", F.lit(0)), F.col("item8.status")
    has = F.col("has_company") & (n > 0)
    thin, inline = (status == "extracted") & (n < 20), (status == "incorporated_by_reference") & (n > 50)
    apart = F.coalesce(F.abs(F.col("first_fy") - F.col("fiscal_year")) > 1, F.lit(False))
    misses = F.filter("checks", lambda r: ~r["found_in_item8"])
    text = lambda c: c.cast("string")
    warnings = F.array_compact(
        F.array(
            F.when(thin, F.concat(F.lit("few_facts: item 8 is extracted, with "), text(n), F.lit(" facts"))),
            F.when(inline, F.concat(F.lit("many_facts: item 8 is incorporated by reference, with "), text(n), F.lit(" facts"))),
            F.when(apart, F.concat(F.lit("period: facts are of "), text(F.col("first_fy")), F.lit(", the filing of "), text(F.col("fiscal_year")), F.lit(", ending "), F.col("period_ending")),),
            F.when(
                (status == "extracted") & (F.size(misses) > 0),
                F.concat(F.lit("values_missing: "), text(F.size(misses)), F.lit(" of "), text(F.size("checks")), F.lit(" are not in item 8: "), F.array_join(F.transform(misses, lambda r: r["concept"]), ", ")),
            ),
        )
    )
    missing = F.when(~F.col("has_company"), F.array(F.lit("no_company: no facts of this filer"))).otherwise(
        F.array(F.concat(F.lit("no_facts: the filer has facts, but none of "), F.col("accession")))
    )
    return joined.select(
        "filing_id", has.alias("has_xbrl_data"), F.when(has, n).otherwise(0).cast("int").alias("total_facts"),
        (~has | ~F.coalesce(thin | inline, F.lit(False))).alias("item_8_status_consistent"), (~has | ~apart).alias("period_aligned"),
        F.when(has, F.coalesce("checks", F.array())).otherwise(F.array()).alias("numeric_reconciliations"), F.when(has, warnings).otherwise(missing).alias("warnings"),
    )
