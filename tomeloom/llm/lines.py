"""Line dedup by winnowing over line hashes.

A window is a shortest run of non-blank lines with at least ``least_words``
words, from its first line on or back from its last line; the least line hash of each window (the last of equals) is a
fingerprint, so two places that share a window share its fingerprint.
Fingerprints met once are dropped; windows of the others are joined with the
first place that has the same window, in order of (doc_id, line); each match is
extended both ways while the lines stay equal; and the later run is deleted.
One partner a window is enough: a line in a run that any earlier place has lies
in a window within that run, from the run's first line on or back from the line
itself, and the first place of that window is earlier too.
The first occurrence of every line survives, since each deleted line has an
equal one at an earlier place.

Lines are parted by line feeds and compared without outer white space.  Blank
lines are no part of a run and stay.

Defined cases: null and empty texts stay as they are; a text of fewer than
``least_words`` words is never touched; rows without an id are left out; rows
that share id and text are one document and each get its result; rows that
share the id alone are ordered by a hash of their text; an empty table gives no
rows.  ``remove_repeated_lines`` passes any other columns through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes
from ._base import Scratch, few, table

LEAST_WORDS = 10
_WHITE = " \t\n\x0b\x0c\r"
_FINGERPRINTS = "array<struct<hash:bigint,windows:array<struct<key:bigint,start:int>>>>"
_FP_ARROW = pa.list_(pa.struct([("hash", pa.int64()), ("windows", pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int32())])))]))


def line_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and word count of each non-blank line of each text, and the index of each text's first line (n + 1)."""
    buf, offs = _bytes.buffers(col)
    start, end, first = _bytes.words(buf, offs)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, first
    breaks = np.concatenate([[0], np.cumsum(buf == 0x0A)])[start]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    head = np.ones(len(start), bool)
    head[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(start)) - 1
    return _bytes.span_hash(_bytes.prefix_hash(buf), start[at], end[last]), last - at + 1, np.searchsorted(at, first)


def windows(h: np.ndarray, n_words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, key and fingerprint place of every window."""
    doc_start, doc_end = (np.repeat(x, np.diff(first)) for x in (first[:-1], first[1:]))
    upto = np.cumsum(n_words)
    fills = np.searchsorted(upto, upto - n_words + least)  # the line that fills the window
    start = np.flatnonzero(fills < doc_end)
    back = np.searchsorted(upto - n_words, upto - least, "right") - 1  # the line from which on a window ends here
    more = np.flatnonzero(back >= doc_start)
    more = more[fills[back[more]] < more]  # else the window is there already
    start, end = np.concatenate([start, back[more]]), np.concatenate([fills[start], more])
    key, low, place = h[start].copy(), h[start].copy(), start.copy()
    for step in range(1, int((end - start).max(initial=0)) + 1):
        on = np.flatnonzero(start + step <= end)
        x = h[start[on] + step]
        key[on] = key[on] * np.uint64(0xC2B2AE3D27D4EB4F) + x
        less = x <= low[on]
        low[on[less]], place[on[less]] = x[less], start[on[less]] + step
    return start, _bytes.mix(key), place


def _line_table(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, text_key, lines, words and fingerprints of each document."""

    def run(parts):
        for batch in parts:
            for lo, hi in _bytes.batches(batch.column(2)):
                rows = batch.slice(lo, hi - lo)
                h, n_words, first = line_hashes(rows.column(2))
                start, key, place = windows(h, n_words, first, least)
                signed, doc = h.astype(np.int64), np.searchsorted(first, start, "right") - 1
                fps: list[dict[int, dict]] = [{} for _ in range(rows.num_rows)]
                for d, s, k, p in zip(doc.tolist(), start.tolist(), key.astype(np.int64).tolist(), place.tolist(), strict=True):
                    fps[d].setdefault(p, {"hash": int(signed[p]), "windows": []})["windows"].append({"key": k, "start": s - int(first[d])})
                offs = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.ListArray.from_arrays(offs, pa.array(signed)), pa.ListArray.from_arrays(offs, pa.array(n_words, pa.int32())), pa.array([list(f.values()) for f in fps], _FP_ARROW)],
                    ["doc_id", "text_key", "lines", "words", "fingerprints"],
                )

    return docs.mapInArrow(run, f"doc_id long, text_key long, lines array<long>, words array<int>, fingerprints {_FINGERPRINTS}")


def _extended(pairs: DataFrame) -> DataFrame:
    """doc_id, text_key, run (start, end) of the later runs; pairs: both documents' lines, the shift and the matched starts."""

    def run(parts):
        for batch in parts:
            out: list[tuple] = []
            for row in batch.to_pylist():
                own, other, shift = np.array(row["lines"], np.int64), np.array(row["first_lines"], np.int64), row["shift"]
                lo, hi = max(0, shift), min(len(own), len(other) + shift)
                equal = own[lo:hi] == other[lo - shift : hi - shift]
                breaks = np.flatnonzero(~equal)
                spans = set()
                for s in row["starts"]:
                    i = int(np.searchsorted(breaks, s - lo))
                    a = lo + (int(breaks[i - 1]) + 1 if i else 0)
                    b = lo + (int(breaks[i]) if i < len(breaks) else len(equal))
                    if b > a:  # else the window's key was equal by chance
                        spans.add((a, b))
                out += [(row["doc_id"], row["text_key"], a, b) for a, b in spans]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "text_key", "start", "end"])

    return pairs.mapInArrow(run, "doc_id long, text_key long, start int, end int")


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_key, runs: the line ranges of each document that repeat earlier ones; docs: doc_id, text_key, text."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.put(_line_table(docs, least_words), "lines")
    prints = lines.select("doc_id", "text_key", F.explode("fingerprints").alias("f")).select("doc_id", "text_key", F.col("f.hash").alias("hash"), F.col("f.windows").alias("windows"))
    repeated = prints.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    known = prints.join(repeated, "hash", "left_semi").select("doc_id", "text_key", F.explode("windows").alias("w")).select("doc_id", "text_key", F.col("w.key").alias("key"), F.col("w.start").alias("start"))
    known = scratch.put(known, "windows", F.count("*"))
    n_known = scratch.observed
    place = F.struct("doc_id", "text_key", "start")
    firsts = known.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("key", "first")
    matches = known.join(firsts, "key").where(place != F.col("first"))
    diagonals = matches.select("doc_id", "text_key", "start", F.col("first.doc_id").alias("first_doc"), F.col("first.text_key").alias("first_key"), (F.col("start") - F.col("first.start")).alias("shift"))
    grouped = diagonals.groupBy("doc_id", "text_key", "first_doc", "first_key", "shift").agg(F.collect_set("start").alias("starts"))
    grouped = scratch.put(few(grouped, n_known, 20_000), "diagonals")
    own = lines.select("doc_id", "text_key", "lines").dropDuplicates(["doc_id", "text_key"])
    other = own.select(F.col("doc_id").alias("first_doc"), F.col("text_key").alias("first_key"), F.col("lines").alias("first_lines"))
    with_first = grouped.join(other, ["first_doc", "first_key"]).select("doc_id", "text_key", "shift", "starts", "first_lines")
    pairs = with_first.join(own, ["doc_id", "text_key"])
    found = _extended(pairs).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    found = scratch.put(few(found, n_known, 20_000), "runs")
    scratch.drop("lines", "windows", "diagonals")
    return found


def _without_runs(text: str | None, runs) -> tuple[str | None, int]:
    """The text without the non-blank lines numbered in runs, and how many went."""
    if not runs:
        return text, 0
    gone = set()
    for r in runs:
        gone.update(range(r["start"], r["end"]))
    kept, no = [], 0
    for line in text.split("\n"):
        if line.strip(_WHITE):
            if no not in gone:
                kept.append(line)
            no += 1
        else:
            kept.append(line)
    return "\n".join(kept), len(gone)


def remove_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS, *, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """docs with the later repeated runs deleted from the text; removed_col, if named, gets the number of lines deleted."""
    names, held = docs.columns, "_row"
    while held in names:
        held = f"_{held}"
    # the given columns travel in one struct, so that none can clash with those used here
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.struct(*names).alias(held))
    runs = repeated_runs(rows.select("doc_id", "text_key", F.coalesce(F.col(f"{held}.{text_col}"), F.lit("")).alias("text")), least_words)
    joined = rows.join(runs.hint("merge"), ["doc_id", "text_key"], "left").select(*[F.col(f"{held}.`{c}`").alias(c) for c in names], F.col("runs").alias(held))
    at, out_names = names.index(text_col), [*names, *([removed_col] if removed_col else [])]

    def run(parts):
        for batch in parts:
            texts, runs_col = batch.column(at), batch.column(len(names))
            hit = np.flatnonzero(np.asarray(runs_col.is_valid()))
            columns, n_gone = list(batch.columns[: len(names)]), [0] * batch.num_rows
            if len(hit):
                new = texts.to_pylist()
                for i in hit.tolist():
                    new[i], n_gone[i] = _without_runs(new[i], runs_col[i].as_py())
                columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(n_gone, pa.int64())] if removed_col else [])], out_names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, schema + (f", `{removed_col}` long" if removed_col else ""))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs, removed_col="n_lines_removed").select("doc_id", "text", "n_lines_removed")
