"""Majority votes of several voters, and what they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.51


def tally(ballots: DataFrame, asked: DataFrame) -> DataFrame:
    """filing_id, item_number, pick, n_top, n_votes, fallback_used.

    ballots: filing_id, item_number, provider_pos, value (null: no vote);
    asked: filing_id, item_number, fallback.  Without a vote, or with a tie and a
    fallback, the fallback is picked; a tie without one goes to the first vote.
    """
    key = ["filing_id", "item_number"]
    counts = ballots.where("value IS NOT NULL").groupBy(*key, "value").agg(F.count("*").alias("n"), F.min("provider_pos").alias("first"))
    # one row a question: the tops by count, the votes by place
    per = counts.groupBy(*key).agg(F.sum("n").alias("n_votes"), F.max("n").alias("top"), F.min_by(F.struct("value", "n"), "first").alias("earliest"), F.max_by("value", "n").alias("most"), F.collect_list("n").alias("ns"))
    rows = asked.join(per, key, "left")
    tie = F.size(F.filter("ns", lambda x: x == F.col("top"))) > 1
    back = F.col("n_votes").isNull() | (tie & F.col("fallback").isNotNull())
    return rows.select(
        *key, F.when(back, F.col("fallback")).when(tie, F.col("earliest.value")).otherwise(F.col("most")).alias("pick"),
        F.when(back, 0).when(tie, F.col("earliest.n")).otherwise(F.col("top")).alias("n_top"), F.coalesce("n_votes", F.lit(0)).alias("n_votes"), back.alias("fallback_used"),
    )


def overridden(votes: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """filing_id, item_number, status, old_status, overridden; items: filing_id, item_number, status."""
    key = ["filing_id", "item_number"]
    sure = F.col("n_top") >= threshold * F.col("n_votes")
    change = F.coalesce(~F.col("fallback_used") & sure & (F.col("pick") != F.col("status")), F.lit(False))
    rows = items.join(votes, key, "left")
    return rows.select(*key, F.when(change, F.col("pick")).otherwise(F.col("status")).alias("status"), F.col("status").alias("old_status"), change.alias("overridden"))


def first_calls(ballots: DataFrame) -> DataFrame:
    """The ballot of the first provider of each question."""
    first = Window.partitionBy("filing_id", "item_number").orderBy("provider_pos")
    return ballots.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
