"""Filing tables, expectation files, cached company facts and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims

# Shapes of the JSON files.
GOLD = """_comment string, filing struct<cik:string,accession:string,form_type:string,filing_date:string,period_ending:string,primary_document:string,registrant_name:string,format_quirks:array<string>>,
cover_page_incorporates struct<_note:string,target_form:string,expected_year:int>, expected_items array<struct<part:int,item_number:string,status:string,title_hint:string,_note:string>>,
known_limitations array<string>, char_ranges_html_text string"""
SILVER = """_comment string, filings array<struct<key:string,cik:string,accession:string,form_type:string,period:string,characteristic:string,
expected:struct<min_items:int,max_items:int,is_abs:boolean,must_have_status:map<string,array<string>>,must_not_have:array<string>>>>"""
TTL_HOURS = 24


def annual_reports(filings: DataFrame) -> DataFrame:
    return filings.where(F.col("form_type").isin(*dims.FORMS))


def find_filing(filings: DataFrame, cik: str, accession: str) -> DataFrame:
    """The one filing with this accession; an error if the company has none."""
    found = annual_reports(filings).where((F.col("cik") == cik) & (F.col("accession") == accession)).limit(1)
    count = found.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, F.raise_error(F.lit(f"no annual report {accession} for {cik}"))).otherwise(F.lit(1)).alias("n"))
    return found.join(count, F.lit(True), "right").where("n = 1").drop("n")  # the filter keeps the error in the plan


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).json(path, multiLine=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_silver(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """One row a filing; key keeps one of them."""
    rows = spark.read.schema(SILVER).json(path, multiLine=True).select(F.explode("filings").alias("f")).select("f.*")
    return rows.where(F.col("key") == key) if key else rows


def gold_items(gold: DataFrame) -> DataFrame:
    """filing_id (the accession), ord, item_number, status of the expected items."""
    return gold.select(F.col("filing.accession").alias("filing_id"), F.posexplode("expected_items").alias("ord", "x")).select("filing_id", "ord", "x.item_number", "x.status")


def silver_constraints(silver: DataFrame) -> DataFrame:
    return silver.select(F.col("accession").alias("filing_id"), "expected.*")


def facts_file(cik: Column) -> Column:
    """Name of a company's facts file."""
    return F.concat(F.lit("CIK"), F.lpad(cik.cast("long").cast("string"), 10, "0"), F.lit(".json"))


def read_facts(spark: SparkSession, path: str, hours: int = TTL_HOURS, now: Column | None = None) -> DataFrame:
    """file, company (JSON text), fresh: whether the file is younger than the time to live."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("company"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("written"))
    return rows.select("file", "company", is_fresh(F.col("written"), now if now is not None else F.current_timestamp(), hours).alias("fresh"))


def is_fresh(written: Column, now: Column, hours: int = TTL_HOURS) -> Column:
    return written > now - F.expr(f"INTERVAL {hours} HOURS")


def catalogue(gold: DataFrame, silver: DataFrame, labels: dict[str, str], notes: dict[str, str]) -> DataFrame:
    """Gold then silver filings with defaults: ord, slug, label, cik, accession, form_type, period_ending, characteristic, source."""
    def named(c: Column, names: dict[str, str], default: Column) -> Column:
        if not names:
            return default
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), default)

    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default))
    slug = F.col("slug")
    g = gold.select(F.lit(0).alias("ord"), slug, named(slug, labels, slug).alias("label"), text("cik").alias("cik"), text("accession").alias("accession"), text("form_type", "10-K").alias("form_type"), text("period_ending").alias("period_ending"), named(slug, notes, text("comment")).alias("characteristic"), F.lit("gold").alias("source"))
    s = silver.select(F.lit(1).alias("ord"), slug, named(slug, labels, slug).alias("label"), text("cik").alias("cik"), text("accession").alias("accession"), text("form_type", "10-K").alias("form_type"), text("period_ending").alias("period_ending"), text("comment").alias("characteristic"), F.lit("silver").alias("source"))
    return g.unionByName(s)


def read_or_derive(spark: SparkSession, manifest: str, derive) -> DataFrame:
    """The manifest's rows if there is one, else what ``derive`` makes; decided when the plan is built."""
    at = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    return spark.read.json(manifest, multiLine=True) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else derive()


def of_source(catalogued: DataFrame, source: str) -> DataFrame:
    """The rows of one source, gold or silver, in the order of the catalogue."""
    return catalogued.where(F.col("source") == source)


def refreshed(held: DataFrame, fetched: DataFrame) -> DataFrame:
    """file, company of the facts, stale ones replaced where they were fetched again; held: file, company, fresh; fetched: file, company (null: not there)."""
    rows = held.join(fetched.select("file", F.col("company").alias("new"), F.lit(True).alias("asked")), "file", "full")
    return rows.select("file", F.when(F.coalesce("fresh", F.lit(False)), F.col("company")).when(F.col("asked"), F.col("new")).otherwise(F.col("company")).alias("company"))
