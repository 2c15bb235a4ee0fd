"""The corpus pipeline: labelled quality, repeated lines, near copies, benchmark passages, packing.

Every stage works on all documents that its predecessor kept.  All but the last
return the columns of ``documents``; the last returns the packed pieces.

Defined cases, for every stage: an empty table gives no rows; rows without an id
are left out; repeated rows are each a row; null texts are empty; other columns
than those of ``documents`` are dropped, so their names can't clash.  A blank
text is scored by the quality stage like any other; line dedup drops documents
that are blank after it, so none is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeloom.llm._base import Scratch, doc_rows, table
from tomeloom.llm.decontaminate import decontaminate
from tomeloom.llm.lines import remove_repeated_lines
from tomeloom.llm.near_dups import keep_one_of_each
from tomeloom.llm.packing import pack_documents, vocabulary
from tomeloom.llm.quality import SAMPLE_ROWS, THRESHOLD, fit_quality, learnable, with_quality, with_statistics

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text has it now."""
    return docs.where("doc_id IS NOT NULL").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the labels of the held-out fold are not learned from."""
    docs = _given(docs)
    sample = F.broadcast(learnable(table(spark, sf_dir, "labels"), "quality", 4, 2, SAMPLE_ROWS).select("doc_id"))  # at most SAMPLE_ROWS ids
    labelled = doc_rows(docs).join(sample, "doc_id", "left_semi")
    stats = Scratch(spark, "quality-stage").put(with_statistics(labelled).drop("text"), "stats")
    model = fit_quality(stats, table(spark, sf_dir, "labels"))
    return _documents(with_quality(docs, model, score_col="_quality").where(F.col("_quality") >= THRESHOLD))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; what is blank then goes."""
    return _documents(remove_repeated_lines(_given(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return _documents(keep_one_of_each(_given(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return _documents(decontaminate(_given(docs), table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Models, extension of matches and tokens are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.put(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
