"""Scores of predicted sections against labelled ones, and constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Counts per filing; ratios are left to ``ratios``.

    Both: filing_id, ord, item_number, status.  Synthetic cover rows don't
    count; of repeated items the last one's status counts, and every distinct
    (item, status) pair.
    """
    def gathered(rows: DataFrame, side: str) -> DataFrame:
        own = rows.where("item_number <> 'cover'").select("filing_id", "ord", F.upper("item_number").alias("item"), "status")
        last = own.groupBy("filing_id", "item").agg(F.max_by("status", "ord").alias("last"), F.collect_set("status").alias("all"), F.count("*").alias("n"))
        return last.select("filing_id", "item", F.struct("last", "all", "n").alias(side))

    both = gathered(predicted, "got").join(gathered(gold, "want"), ["filing_id", "item"], "full")
    hit = F.col("got").isNotNull() & F.col("want").isNotNull()
    return both.groupBy("filing_id").agg(
        F.coalesce(F.sum("got.n"), F.lit(0)).alias("items_actual"), F.coalesce(F.sum("want.n"), F.lit(0)).alias("items_expected"),
        F.count_if(hit).alias("tp"), F.count_if(F.col("want").isNull()).alias("fp"), F.count_if(F.col("got").isNull()).alias("fn"),
        F.count_if(hit & (F.col("got.last") == F.col("want.last"))).alias("status_correct"),
        F.coalesce(F.sum(F.size(F.array_intersect("got.all", "want.all"))), F.lit(0)).alias("pairs_correct"), F.coalesce(F.sum(F.size("want.all")), F.lit(0)).alias("pairs_expected"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("want").isNull(), F.col("item")))), ",").alias("fp_items"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("got").isNull(), F.col("item")))), ",").alias("fn_items"),
        F.array_join(F.array_sort(F.collect_list(F.when(hit & (F.col("got.last") != F.col("want.last")), F.concat_ws(":", "item", "want.last", "got.last")))), ",").alias("mismatches"),
    )


def ratios(counts: DataFrame) -> DataFrame:
    """Recall, precision, status accuracy and full-match rate per filing; 0 where nothing was to be found."""
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    return counts.select("filing_id", rate(c("tp"), c("tp") + c("fn")).alias("item_recall"), rate(c("tp"), c("tp") + c("fp")).alias("item_precision"), rate(c("status_correct"), c("tp")).alias("status_accuracy"), rate(c("pairs_correct"), c("pairs_expected")).alias("full_match_rate"))


def violations(predicted: DataFrame, constraints: DataFrame) -> DataFrame:
    """filing_id, violations; constraints: filing_id, min_items, max_items, must_not_have (array), must_have_status (map), is_abs, with nulls for what isn't asked."""
    own = predicted.where("item_number <> 'cover'")
    got = own.groupBy("filing_id").agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("item_number", "status"))).alias("statuses"), F.bool_or(F.col("item_number") == "abs").alias("abs"))
    rows = constraints.join(got, "filing_id", "left")
    n, empty = F.coalesce("n", F.lit(0)), F.create_map().cast("map<string,string>")
    statuses = F.coalesce("statuses", empty)
    text = lambda c: c.cast("string")
    # fixed values: the words of the violations, which results are compared by
    required = F.transform(F.array_sort(F.map_entries("must_have_status")), lambda e: (
        F.when(~F.map_contains_key(statuses, e["key"]), F.concat(F.lit("required item "), e["key"], F.lit(" missing")))
        .when(~F.array_contains(e["value"], F.try_element_at(statuses, e["key"])), F.concat(F.lit("item "), e["key"], F.lit(" has status '"), F.try_element_at(statuses, e["key"]), F.lit("', expected one of ['"), F.array_join(e["value"], "', '"), F.lit("']")))
    ))
    forbidden = F.transform("must_not_have", lambda x: F.when(F.map_contains_key(statuses, x), F.concat(F.lit("unexpected item "), x, F.lit(" present (era boundary)"))))
    abs_seen = F.coalesce("abs", F.lit(False))
    checks = F.concat(
        F.array(F.when(n < F.col("min_items"), F.concat(F.lit("min_items="), text(F.col("min_items")), F.lit(" but got "), text(n))), F.when(n > F.col("max_items"), F.concat(F.lit("max_items="), text(F.col("max_items")), F.lit(" but got "), text(n)))),
        F.coalesce(forbidden, F.array().cast("array<string>")), F.coalesce(required, F.array().cast("array<string>")),
        F.array(F.when(abs_seen != F.col("is_abs"), F.concat(F.lit("is_abs="), text(abs_seen), F.lit(", expected "), text(F.col("is_abs"))))),
    )
    return rows.select("filing_id", F.array_compact(checks).alias("violations"))
