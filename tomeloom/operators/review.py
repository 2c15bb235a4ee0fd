"""What a review of doubtful sections asks for, what its votes change, and how results are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import status as st
from . import votes

PROMPT_CHARS = 4_000
CUT_MARK = "\n[text cut]"
INSTRUCTION = "Name the status of the section as JSON with one key, status."


def prompts(sections: DataFrame) -> DataFrame:
    """filing_id, item_number, turn, role, content of the messages about every doubtful section; sections: status, content_text too."""
    doubt = sections.where(st.review_reason(F.col("status"), F.col("content_text")).isNotNull())
    text = F.coalesce("content_text", F.lit(""))
    cut = F.when(F.length(text) > PROMPT_CHARS, F.concat(F.substring(text, 1, PROMPT_CHARS), F.lit(CUT_MARK))).otherwise(text)
    asked = F.concat(F.lit("Item "), F.col("item_number"), F.lit(":\n"), cut)
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(INSTRUCTION).alias("content")), F.struct(F.lit("user").alias("role"), asked.alias("content")))
    return doubt.select("filing_id", "item_number", F.posexplode(messages).alias("turn", "m")).select("filing_id", "item_number", "turn", "m.role", "m.content")


def reviewed(sections: DataFrame, ballots: DataFrame) -> DataFrame:
    """filing_id, item_number, status, warning: the sections with the statuses that their votes give, and what the votes did to doubtful ones.

    ballots: filing_id, item_number, provider_pos, raw.  Only doubtful sections are asked about.
    """
    key = ["filing_id", "item_number"]
    doubt = sections.where(st.review_reason(F.col("status"), F.col("content_text")).isNotNull()).select(*key, "status")
    won = votes.tally(ballots.withColumn("value", st.ballot_status(F.col("raw"))), doubt.withColumnRenamed("status", "fallback"))
    told = votes.overridden(won, doubt).join(won.select(*key, "n_top", "n_votes"), key)
    share = F.concat(F.col("n_top"), F.lit(" of "), F.col("n_votes"))
    warning = F.when(F.col("n_votes") == 0, F.concat(F.lit("unanswered: item "), F.col("item_number"))).when(
        F.col("overridden"), F.concat(F.lit("overridden: item "), F.col("item_number"), F.lit(" from "), F.col("old_status"), F.lit(" to "), F.col("status"), F.lit(" by "), share)
    ).otherwise(F.concat(F.lit("kept: item "), F.col("item_number"), F.lit(" as "), F.col("old_status")))
    new = told.select(*key, F.col("status").alias("new_status"), warning.alias("warning"))
    return sections.join(new, key, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def alignment_rates(items: DataFrame) -> DataFrame:
    """filing_id, items, text_rate: the share of items that have a place in the text; items: filing_id, start."""
    return items.groupBy("filing_id").agg(F.count("*").alias("items"), (F.count("start") / F.count("*")).alias("text_rate"))


def is_dimmed(applicable_in_era: Column, status: Column) -> Column:
    """Whether a page shows the row dimmed: the item did not exist yet, though a section was found."""
    return ~applicable_in_era & (status == "extracted")


def item_details(items: DataFrame) -> DataFrame:
    """The first row of each item of a filing, with its dim flag; items: filing_id, ord, item_number, status, applicable_in_era."""
    first = Window.partitionBy("filing_id", "item_number").orderBy("ord")
    rows = items.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    return rows.withColumn("dimmed", is_dimmed(F.col("applicable_in_era"), F.col("status")))


def tallies(results: DataFrame) -> DataFrame:
    """succeeded, failed: how many results name no error, and how many do; results: error."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def is_inline_xbrl(*flags: Column) -> Column:
    """Whether any of a filing's flags says that its facts are inline."""
    out = F.lit(False)
    for flag in flags:
        out = out | F.coalesce(flag, F.lit(False))
    return out


def status_line(items: Column, milliseconds: Column, warnings: Column) -> Column:
    """Parts that are there, joined as one line."""
    return F.concat_ws(" · ", F.concat(items.cast("string"), F.lit(" items")), F.when(milliseconds > 0, F.concat(F.format_number(milliseconds / 1000, 1), F.lit(" s"))), F.when(F.size(warnings) > 0, F.concat(F.size(warnings).cast("string"), F.lit(" warnings"))))
