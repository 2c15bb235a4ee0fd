"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op3_decontamination
from .fingerprint import op7_document_fingerprints
from .html_text import op4_html_text
from .lines import op2_line_dedup
from .near_dups import op1_near_dups
from .oracles import ORACLE_SQL
from .packing import op8_best_fit_packing
from .quality import op5_quality
from .secrets import op10_secret_scan
from .substrings import op9_repeated_substrings
from .toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dups": op1_near_dups,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_html_text": op4_html_text,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_repeated_substrings": op9_repeated_substrings,
    "op10_secret_scan": op10_secret_scan,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
