"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are fitted on a bounded sample of labelled rows; every
path from a root is a conjunctive rule over the statistics; an L1-penalised
logistic fit keeps few of the rules, and these are compiled into one Spark
column expression.  The statistics cover whole texts.

Defined cases: null and empty texts have all statistics 0 and are scored as any
other; rows without an id are left out; labels that are null are not learned
from; without both labels among the learnable rows every score is the share of
label 1 (0.5 if there are none); repeated rows are scored each; other columns
are passed through only by ``with_quality``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes
from ._base import Scratch, doc_rows, table

SAMPLE_ROWS = 20_000  # most labelled rows that a model is fitted on
THRESHOLD = 0.7
STATS = (
    "n_words", "mean_word", "long_words", "short_words", "symbols", "pipes", "uppers", "digits", "commas_dots",
    "repeat_next", "distinct_words", "words_a_line", "lone_symbols", "line_ends", "repeat_pairs",
)
_CLASS = np.zeros(256, np.uint8)
for _chars, _code in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,", 3), (b"|", 4), (b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{}~", 5), (b"\n", 6)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _code


def text_statistics(col: pa.Array) -> np.ndarray:
    """One row of STATS per text."""
    n = len(col)
    out = np.zeros((n, len(STATS)))
    for lo, hi in _bytes.batches(col):
        buf, offs = _bytes.buffers(col.slice(lo, hi - lo))
        if len(buf):
            out[lo:hi] = _statistics(buf, offs)
    return out


def _statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    start, end, first = _bytes.words(buf, offs)
    n_words, size = np.diff(first), np.diff(offs)
    doc = np.repeat(np.arange(n), n_words)
    per_word = lambda x: np.bincount(doc, weights=x, minlength=n) / np.maximum(n_words, 1)
    codes = _CLASS[buf]
    counts = [np.zeros(n)] * 7
    for c in range(1, 7):
        at = np.flatnonzero(codes == c)
        counts[c] = np.diff(np.searchsorted(at, offs))
    length = end - start
    h = _bytes.span_hash(_bytes.prefix_hash(buf), start, end)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    lone = (codes[start] == 5) | (codes[start] == 4) if len(h) else same
    pairs, pair_offs = _bytes.shingles(h, first, 2)
    distinct, repeated = np.zeros(n), np.zeros(n)
    for i in range(n):
        if n_words[i]:
            distinct[i] = len(np.unique(h[first[i] : first[i + 1]])) / n_words[i]
            p = pairs[pair_offs[i] : pair_offs[i + 1]]
            repeated[i] = 1 - len(np.unique(p)) / len(p)
    chars = np.maximum(size, 1)
    lines = counts[6] + (size > 0)
    ended = np.zeros(n)
    at = np.flatnonzero(codes == 6)
    at = at[at > 0]
    ended += np.bincount(np.searchsorted(offs, at[codes[at - 1] == 3], "right") - 1, minlength=n)[:n] / np.maximum(counts[6], 1)
    return np.column_stack([
        n_words, per_word(length), per_word(length > 12), per_word(length <= 3), counts[5] / chars, counts[4] / chars, counts[1] / chars, counts[2] / chars, counts[3] / chars,
        per_word(same), distinct, n_words / np.maximum(lines, 1), per_word(lone), ended, repeated,
    ])


def with_statistics(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """df and the statistics of its text as double columns; the text stays."""
    names = [prefix + s for s in STATS]
    at = df.columns.index(text_col)

    def run(parts):
        for batch in parts:
            values = text_statistics(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(values[:, j]) for j in range(len(names))]], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, " + ", ".join(f"`{s}` double" for s in names))


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...]  # weight, conditions (statistic, above, cut)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for w, conditions in self.rules:
            z += w * _holds(x, conditions)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def column(self, prefix: str = "") -> Column:
        """The score as a Spark column over the statistics."""
        z = F.lit(self.intercept)
        for w, conditions in self.rules:
            test = None
            for j, above, cut in conditions:
                c = F.col(f"`{prefix}{STATS[j]}`")
                one = c > cut if above else c <= cut
                test = one if test is None else test & one
            z = z + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in conditions:
        out &= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return out


def _grow(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list) -> list[tuple[np.ndarray, float]]:
    """Leaves (rows, value) of one tree by histograms; every node's path goes to out."""
    if path:
        out.append(path)
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-3, None, None)
    if depth and len(rows) >= 20:
        for j in range(bins.shape[1]):
            if not len(edges[j]):
                continue
            gs = np.cumsum(np.bincount(bins[rows, j], grad[rows], len(edges[j]) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, j], hess[rows], len(edges[j]) + 1))[:-1]
            ok = (hs > 1) & (h - hs > 1)
            gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    if best[1] is None:
        return [(rows, g / (h + 1))]
    _, j, k = best
    cut, low = float(edges[j][k]), bins[rows, j] <= k
    return _grow(bins, edges, grad, hess, rows[low], depth - 1, (*path, (j, False, cut)), out) + _grow(bins, edges, grad, hess, rows[~low], depth - 1, (*path, (j, True, cut)), out)


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, steps: int = 400, seed: int = 5) -> RuleModel:
    """Paths of boosted trees as rules, weighted by a lasso logistic fit."""
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return RuleModel(float(np.log(p / (1 - p))), ())
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 48))) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    z, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        found: list = []
        leaves = _grow(bins, edges, y - p, p * (1 - p), rows, depth, (), found)
        paths += found
        for leaf, value in leaves:
            z[leaf] += rate * value
    rules = list(dict.fromkeys(paths))
    if not rules:  # too few rows for any split
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    design = np.column_stack([_holds(x, r) for r in rules]).astype(np.float64)
    share = design.mean(0)
    keep = (share > 0.002) & (share < 0.998)
    rules, design = [r for r, k in zip(rules, keep, strict=True) if k], design[:, keep]
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    _, kept = np.unique(design, axis=1, return_index=True)
    rules, design = [rules[i] for i in sorted(kept)], design[:, sorted(kept)]
    mean, n = design.mean(0), len(y)
    scale = np.sqrt(mean * (1 - mean))
    a = (design - mean) / scale
    step = 4 * n / max(np.linalg.norm(a.T @ a, 2), 1e-9)
    w, b = np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        r = (1 / (1 + np.exp(-np.clip(a @ v + vb, -40, 40))) - y) / n
        w2 = v - step * (a.T @ r)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = vb - 4 * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    w = w / scale
    used = [(float(c), r) for c, r in zip(w, rules, strict=True) if abs(c) > 1e-6]
    return RuleModel(float(b - (w * mean).sum()), tuple(used))


def held_out(folds: int, fold: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def learnable(labels: DataFrame, target: str, folds: int, fold: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out fold, chosen by a hash of the id."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out(folds, fold))
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)


def fit_quality(stats: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, rows: int = SAMPLE_ROWS) -> RuleModel:
    """stats: doc_id and the statistics.  At most ``rows`` rows come to the driver."""
    sample = F.broadcast(learnable(labels, "quality", folds, fold, rows))  # bounded by rows
    got = stats.join(sample, "doc_id").select(*STATS, "label").toPandas().sort_values([*STATS, "label"])
    return fit_rules(got[list(STATS)].to_numpy(), got["label"].to_numpy())


def with_quality(docs: DataFrame, model: RuleModel, *, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with the score of each text."""
    p = "_stat_"
    while any(c.startswith(p) for c in docs.columns):
        p = f"_{p}"
    scored = with_statistics(docs, text_col, p)
    return scored.withColumn(score_col, model.column(p)).drop(*[p + s for s in STATS])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    stats = scratch.put(with_statistics(doc_rows(table(spark, sf_dir, "documents"))).drop("text"), "stats")
    model = fit_quality(stats, table(spark, sf_dir, "labels"))
    scored = stats.select("doc_id", held_out(4, 2).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
