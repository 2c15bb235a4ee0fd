"""Result documents: nested JSON, incremental builds, point reads, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def assembled(filings: DataFrame, items: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """One nested row a filing: filing, items in order, meta with the items' warnings, xbrl_validation."""
    if "warning" in items.columns:
        said = items.groupBy("filing_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("ord", "warning")))), lambda x: x["warning"]).alias("_warnings"))
        items = items.drop("warning")
    else:
        said = None
    warnings = F.array().cast("array<string>") if said is None else F.coalesce("_warnings", F.array().cast("array<string>"))
    meta = F.struct(F.lit("1").alias("parser_version"), F.lit(0).alias("extraction_time_ms"), F.lit(0.0).alias("cost_usd"), warnings.alias("warnings"))
    columns = [c for c in items.columns if c != "filing_id"]
    parts = items.groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in columns if c != "ord"]))).alias("items"))
    head = filings.select("filing_id", F.struct(*[c for c in filings.columns if c not in ("filing_id", "raw_text", "raw_html")]).alias("filing"))
    rows = head.join(parts, "filing_id", "left")
    rows = (rows if said is None else rows.join(said, "filing_id", "left")).withColumn("meta", meta).drop("_warnings")
    if validation is None:
        return rows.withColumn("xbrl_validation", F.lit(None).cast("struct<has_xbrl_data:boolean>"))
    return rows.join(validation.select("filing_id", F.struct(*[c for c in validation.columns if c != "filing_id"]).alias("xbrl_validation")), "filing_id", "left")


def write_results(results: DataFrame, path: str, slug: str = "filing_id", force: bool = False) -> None:
    """JSON, one folder a slug; what is already built is left unless forced."""
    todo = results if force else missing(results, path, slug)
    todo.withColumn("slug", F.col(slug)).withColumn("built_at", F.current_timestamp()).write.mode("overwrite" if force else "append").partitionBy("slug").json(path)


def missing(wanted: DataFrame, path: str, slug: str) -> DataFrame:
    spark = wanted.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return wanted
    built = spark.read.json(path).select(F.col("slug").cast("string").alias("_built")).distinct()
    return wanted.join(built, wanted[slug].cast("string") == F.col("_built"), "left_anti")


def read_result(spark: SparkSession, path: str, slug: str) -> DataFrame:
    """The built result of one slug; the partition filter leaves the other folders unread."""
    return spark.read.json(path).where(F.col("slug") == slug)


def markdown(scores: DataFrame) -> DataFrame:
    """One table line a filing."""
    cells = [F.format_string("%.4f", F.col(c).cast("double")) if t == "double" else F.col(c).cast("string") for c, t in scores.dtypes]
    return scores.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def report(scores: DataFrame, title: str) -> DataFrame:
    """line_no, line of a report: title, header, one line a filing in order, mean of every ratio; scores: filing_id and ratios."""
    names = [c for c in scores.columns if c != "filing_id"]
    spark = scores.sparkSession
    head = [title, "", "| " + " | ".join(["filing", *names]) + " |", "|" + " --- |" * (1 + len(names))]
    top = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "block int, place long, line string")
    row = lambda first, cells: F.concat(F.lit("| "), F.concat_ws(" | ", first, *[F.format_string("%.4f", c) for c in cells]), F.lit(" |"))
    lines = scores.select(F.lit(1).alias("block"), F.col("filing_id").alias("place"), row(F.col("filing_id").cast("string"), [F.col(n) for n in names]).alias("line"))
    means = scores.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names]).select(F.lit(2).alias("block"), F.lit(0).cast("long").alias("place"), row(F.lit("mean"), [F.col(n) for n in names]).alias("line"))
    return top.unionByName(lines).unionByName(means)


def write_report(scores: DataFrame, path: str, title: str) -> None:
    """The report as text lines in order, and the scores as JSON beside them."""
    report(scores, title).orderBy("block", "place").select("line").write.mode("overwrite").text(f"{path}/markdown")
    scores.write.mode("overwrite").json(f"{path}/json")


def with_errors(scores: DataFrame, errors: DataFrame) -> DataFrame:
    """Failed filings as rows of zeros that name the error; errors: filing_id, error."""
    rows = scores.join(errors, "filing_id", "full")
    return rows.select("filing_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in scores.columns if c != "filing_id"], "error")
