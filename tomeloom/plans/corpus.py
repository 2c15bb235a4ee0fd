"""Filings made from the documents table, by SQL that Spark and DuckDB both read.

The given documents hold no filings, so every document becomes one: a
projection over its row, without a shuffle.  Its id decides the heading style,
which sections it has, and which of these hold text of the document; its whole
text is dealt over them in order.  A null text is an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import dims
from ..patterns import NBSP
from ..sources.shared import shared_dir

BY_REFERENCE = "The information required by this Item is incorporated herein by reference to our 2024 Proxy Statement."
REMAINING = "The remaining information required by this Item will be included in the 2024 Proxy Statement."
COVER = "DOCUMENTS INCORPORATED BY REFERENCE Securities Act of 1933. Portions of the definitive statement for the 2025 annual meeting of holders."
STYLES = 5


def _text(s: str) -> str:
    """A literal; Spark and DuckDB both read a doubled quote as one."""
    return "'" + s.replace("'", "''") + "'"


def pieces(holds: dict[int, list[bool]], no: int) -> str:
    """The part of the text that section ``no`` holds, where holds[residue of the id] tells which sections hold any."""
    period = len(holds)
    before = "".join(f"{sum(holds[r][:no]):02d}" for r in range(period))
    every = "".join(f"{sum(holds[r]):02d}" for r in range(period))
    count = lambda digits: f"CAST(substring('{digits}', CAST(1 + 2 * (doc_id % {period}) AS INT), 2) AS INT)"
    upto = lambda more: f"CAST(floor(length(body) * ({count(before)} + {more}) / {count(every)}) AS INT)"
    return f"substring(body, 1 + {upto(0)}, {upto(1)} - {upto(0)})"


#: By the id's residue, which sections hold text.
HOLDS = {r: [(r + no) % 9 in (4, 6, 7, 8) and (r + no) % 7 != 0 for no in range(len(dims.ITEMS))] for r in range(63)}


#: By the id's residue, which items a section library gives by key and by label.
KEYED = {r: [(r + no) % 3 == 0 for no in range(len(dims.ITEMS))] for r in range(3)}
LABELLED = {r: [(r + no) % 4 <= 1 for no in range(len(dims.ITEMS))] for r in range(4)}


def _body(no: int) -> str:
    piece = pieces(HOLDS, no)
    return (
        f"CASE (doc_id + {no}) % 9 WHEN 0 THEN 'None.' WHEN 1 THEN 'Not applicable.' WHEN 2 THEN '[Reserved]' "
        f"WHEN 3 THEN {_text(BY_REFERENCE)} WHEN 4 THEN {piece} || ' ' || {_text(REMAINING)} "
        f"WHEN 5 THEN 'See our 2024 Proxy Statement for the details of this matter.' ELSE {piece} END"
    )


def _section(no: int, number: str, title: str) -> str:
    quoted = _text(title)
    head = (
        f"CASE doc_id % {STYLES} WHEN 0 THEN {_text(f'Item {number}. {title}')} WHEN 1 THEN {_text(f'ITEM {number} - {title}.')} "
        f"WHEN 2 THEN upper({quoted}) || '.' WHEN 3 THEN upper({quoted}) ELSE {_text(f'Item {number}.{NBSP}{title}')} END"
    )
    return f"CASE WHEN (doc_id + {no}) % 7 <> 0 THEN {head} || chr(10) || {_body(no)} END"


def _index_line(no: int, number: str, title: str) -> str:
    return f"CASE WHEN (doc_id + {no}) % 7 <> 0 THEN {_text(f'Item {number}.  {title}  ')} || CASE (doc_id + {no}) % 5 WHEN 0 THEN 'Not applicable' WHEN 1 THEN '(a)' WHEN 2 THEN '(b), 12' ELSE '5-43' END END"


def filings_sql(documents: str = "documents") -> str:
    items = [(no, number, title) for no, (number, _, title) in enumerate(dims.ITEMS)]
    sections = ",\n".join(_section(*x) for x in items)
    index = ", ".join(_index_line(*x) for x in items)
    contents = ", ".join(_text(f"Item {number}. {title}") for _, number, title in items[:12])
    return f"""
SELECT doc_id AS filing_id, CAST(doc_id % 97 + 1000 AS VARCHAR(20)) AS cik,
 '0000' || lpad(CAST(doc_id AS VARCHAR(20)), 6, '0') || '-24-000001' AS accession,
 CASE doc_id % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K/A' WHEN 2 THEN '10-K405' ELSE '10-Q' END AS form_type,
 DATE '2003-06-30' + CAST(doc_id * 13 % 8000 AS INT) AS filing_date,
 DATE '2003-03-31' + CAST(doc_id * 13 % 8000 AS INT) AS period_ending,
 concat_ws(chr(10),
  CASE WHEN doc_id % 3 = 0 THEN {_text(COVER)} ELSE 'ANNUAL REPORT' END,
  CASE WHEN doc_id % 41 = 7 THEN 'This report follows Item 1112 of Regulation AB.' END,
  CASE WHEN doc_id % {STYLES} = 4 THEN concat_ws(chr(10), {contents}) END,
  {sections},
  CASE WHEN doc_id % {STYLES} = 3 THEN concat_ws(chr(10), 'FORM 10-K CROSS REFERENCE INDEX', {index}) END
 ) AS raw_text
FROM (SELECT doc_id, coalesce(text, '') AS body FROM {documents} WHERE doc_id IS NOT NULL) AS d"""


_WRITTEN: dict[tuple[str, str], str] = {}


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings, written once a session to the shared folder: every query reads them as a table, with its columns pruned."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN or not _there(spark, _WRITTEN[key]):
        path = f"{shared_dir(spark)}/filings-{uuid.uuid4().hex[:12]}"
        _write(spark.sql(filings_sql("{documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def _write(rows: DataFrame, path: str) -> None:
    """rows written without whole-stage code: that of all sections is over the 64 KB of a method, so the driver would compile it in vain."""
    conf, name = rows.sparkSession.conf, "spark.sql.codegen.wholeStage"
    before = conf.get(name, None)
    conf.set(name, "false")
    try:
        rows.write.parquet(path)
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
