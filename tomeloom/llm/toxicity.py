"""Toxicity: a weighted finite-state grammar over the words of a clause.

The word transducer maps words to symbols: insults and threats (weighted word
beginnings, learned from labelled rows; threats are those that a target mostly
follows), and closed classes of targets, negations, reporting verbs and threats.
The clause transducers of ``grammar`` (negation, report, target, score) are
composed and read each clause that holds an insult or a threat: an insult scores
more when it has a target, less when it is negated or reported, and a threat
needs a target.  Matched clauses are scored, not isolated words; what they give
per document is calibrated on the labelled rows.

Defined cases: null and empty texts match nothing and get the score of no match;
rows without an id are left out; null labels are not learned from; without both
labels among the learnable rows there are no stems and every score is the share
of label 1 (0.5 if there are none); repeated rows are scored each; an empty table
gives no rows; other columns than id and text are ignored, so their names can't
clash; a very long text without the end of a clause is one clause.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes
from . import grammar as rules
from ._base import Scratch, doc_rows, table
from .quality import held_out, learnable

SAMPLE_ROWS = 20_000  # most labelled rows that stems and calibration are learned from
THRESHOLD = 0.5
SHORTEST, LONGEST = 3, 12  # bytes of a stem
AIMED = 0.5  # share of a threat's texts in which a target follows
FEATURES = ("clauses", "weight", "heaviest", "addressed", "softened", "density")

# Closed-class words of the grammar in the corpus languages.
ADDRESS = "you your you're u he she they them him her him people du dich dir ihr euch sie tu te toi vous ils elle tú usted ustedes ellos él ella eres"
NEGATION = "not no never isn't aren't nobody don't nicht kein keine nie ne pas jamais non nunca nadie ni"
REPORT = "said says say told wrote writes called quoted alleged claims claimed sagte schrieb nannte dit disait écrit dijo dice escribió llamó"
THREAT = "kill hurt destroy beat burn shoot töten umbringen verletzen tuer frapper brûler matar golpear quemar"
def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the letters of U+00C0 to U+00DE."""
    out = _bytes.lower(buf)
    if len(out) > 1:
        latin = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][latin] += 0x20
    return out


def stem_hash(stem: bytes) -> int:
    buf = np.frombuffer(stem, np.uint8)
    return int(_bytes.span_hash(_bytes.prefix_hash(buf), np.array([0]), np.array([len(buf)]))[0])


@dataclass(frozen=True)
class Grammar:
    """Weights by word beginning, of insults and of threats; the closed classes are whole words."""

    stems: dict[bytes, float]
    threats: dict[bytes, float] = field(default_factory=dict)
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(init=False)
    closed: tuple[np.ndarray, np.ndarray] = field(init=False)

    def __post_init__(self):
        lengths: dict[int, dict[int, tuple[float, int]]] = {}
        for symbol, stems in ((rules.INSULT, self.stems), (rules.THREAT, self.threats)):
            for stem, w in stems.items():
                lengths.setdefault(len(stem), {})[stem_hash(stem)] = (w, symbol)
        by_length = {}
        for n, rows in sorted(lengths.items()):
            keys = sorted(rows)
            by_length[n] = np.array(keys, np.uint64), np.array([rows[k][0] for k in keys]), np.array([rows[k][1] for k in keys], np.int64)
        object.__setattr__(self, "by_length", by_length)
        classes = {w.encode(): s for s, ws in ((rules.TARGET, ADDRESS), (rules.NEGATION, NEGATION), (rules.REPORT, REPORT), (rules.THREAT, THREAT)) for w in ws.split()}
        object.__setattr__(self, "closed", _sorted([(stem_hash(w), s) for w, s in classes.items()]))

    def symbols(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each word; the longest stem that begins it counts."""
        symbol, weight = np.zeros(len(start), np.int64), np.ones(len(start))
        at, hit = _find(self.closed[0], _bytes.span_hash(prefix, start, end))
        symbol[hit] = self.closed[1][at].astype(np.int64)
        for n, (keys, weights, kinds) in self.by_length.items():
            long = np.flatnonzero(end - start >= n)
            at, hit = _find(keys, _bytes.span_hash(prefix, start[long], start[long] + n))
            symbol[long[hit]], weight[long[hit]] = kinds[at], weights[at]
        return symbol, weight

    def features(self, col: pa.Array) -> np.ndarray:
        """FEATURES of each text."""
        out = np.zeros((len(col), len(FEATURES)))
        for lo, hi in _bytes.batches(col):
            buf, offs = _bytes.buffers(col.slice(lo, hi - lo))
            low = fold(buf) if len(buf) else buf
            start, end, first = _bytes.words(buf, offs)
            if not len(start):
                continue
            symbol, weight = self.symbols(_bytes.prefix_hash(low), *_strip(low, start, end))
            # a line end before the next word also ends the clause, and so does the text
            ends = np.append(False, _ENDS[buf[end[:-1] - 1]] | _line_between(buf, end, start))
            ends[first[:-1][np.diff(first) > 0]] = True
            clause = np.cumsum(ends)
            out[lo:hi] = _document_features(symbol, weight, clause, first)
        return out


def _document_features(symbol: np.ndarray, weight: np.ndarray, clause: np.ndarray, first: np.ndarray) -> np.ndarray:
    """FEATURES of documents from the words' symbols, weights and clauses; ``first`` has n + 1 places."""
    out = np.zeros((len(first) - 1, len(FEATURES)))
    hot = np.unique(clause[(symbol == rules.INSULT) | (symbol == rules.THREAT)])
    if not len(hot):
        return out
    # words of these clauses; of a row of words that say nothing, those that a negation can reach are enough
    since = np.arange(len(symbol)) - np.maximum.accumulate(np.where(symbol != rules.NONE, np.arange(len(symbol)), -rules.SCOPE - 2))
    at = np.flatnonzero((since <= rules.SCOPE) & np.isin(clause, hot))
    begin = np.searchsorted(clause[at], hot)
    length = np.diff(np.append(begin, len(at)))
    marked, arc = rules.read_clauses(symbol[at], begin, length)
    kind = marked % rules.KINDS
    told = (kind == rules.INSULT) | (kind == rules.THREAT)
    score = np.add.reduceat(np.where(told, arc * weight[at], 0.0), begin)
    targeted = np.logical_or.reduceat(told & (marked & rules.TARGETED > 0), begin)
    soft = np.add.reduceat((kind == rules.INSULT) & (marked & (rules.NEGATED | rules.REPORTED) > 0), begin, dtype=np.int64)
    doc = np.searchsorted(first, at[begin], "right") - 1
    np.add.at(out[:, 0], doc, score > 0)
    np.add.at(out[:, 1], doc, score)
    np.maximum.at(out[:, 2], doc, score)
    np.add.at(out[:, 3], doc, targeted & (score > 0))
    np.add.at(out[:, 4], doc, soft)
    out[:, 5] = out[:, 1] / np.maximum(np.diff(first), 1)
    return out


_ENDS = np.zeros(256, bool)
_ENDS[np.frombuffer(b".!?;:|", np.uint8)] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def _sorted(rows: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(dict(rows).items())
    return np.array([k for k, _ in rows], np.uint64), np.array([v for _, v in rows], float)


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in keys, and which of h have one."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == h)
    return at[hit], hit


def _strip(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without punctuation around."""
    start, end = start.copy(), end.copy()
    for _ in range(4):
        if not len(start):
            break
        start += _PUNCT[buf[start]] & (end - start > 1)
        end -= _PUNCT[buf[end - 1]] & (end - start > 1)
    return start, end


def _line_between(buf: np.ndarray, end: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether white space that holds a line end follows each word but the last."""
    lines = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    return lines[start[1:]] > lines[end[:-1]]


def _stem_counts(parts):
    """(stem, texts of label 1, of label 0, of label 1 where a target follows within two words) over the word beginnings of labelled texts."""
    targets = frozenset(ADDRESS.split())
    toxic, clean, aimed = Counter(), Counter(), Counter()
    for pdf in parts:
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            words = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in text.lower().split()]
            (toxic if label else clean).update(_beginnings(words))
            if label:
                aimed.update(_beginnings([w for i, w in enumerate(words) if targets.intersection(words[i + 1 : i + 3])]))
    rows = [(s, toxic[s], clean.get(s, 0), aimed.get(s, 0)) for s in toxic]
    rows += [(s, 0, n, 0) for s, n in clean.items() if s not in toxic]
    yield pd.DataFrame(rows, columns=["stem", "toxic", "clean", "aimed"])


def _beginnings(words: list[str]) -> set[bytes]:
    stems = set()
    for w in set(words):
        b = w.encode()
        stems.update(b[:n] for n in range(SHORTEST, min(len(b), LONGEST) + 1))
    return stems


def learn_stems(sample: DataFrame) -> Grammar:
    """Word beginnings that texts of label 1 hold far more often; sample: text, label.

    A longer stem that says no more than its own beginning is left out.  What
    comes to the driver are words of the sample, whose rows are bounded.
    """
    n = {int(r[0]): r[1] for r in sample.groupBy("label").count().collect()}
    if not n.get(1) or not n.get(0):
        return Grammar({})
    counts = sample.select("text", "label").mapInPandas(_stem_counts, "stem binary, toxic long, clean long, aimed long")
    counts = counts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("aimed").alias("aimed"))
    least = max(4, n[1] // 400)
    rate1, rate0 = (F.col("toxic") + 0.1) / (n[1] + 0.2), (F.col("clean") + 0.5) / (n[0] + 1)
    rows = counts.where(F.col("toxic") >= least).withColumn("odds", F.log(rate1 / rate0)).where("odds > 2.5").collect()
    kept: dict[bytes, float] = {}
    aimed: dict[bytes, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["stem"]), bytes(r["stem"]))):
        stem = bytes(r["stem"])
        parents = [stem[:m] for m in range(SHORTEST, len(stem)) if stem[:m] in kept]
        if parents and r["odds"] < kept[parents[-1]] + 0.7:
            continue
        kept[stem], aimed[stem] = float(r["odds"]), r["aimed"] / r["toxic"]
    return Grammar({s: w for s, w in kept.items() if aimed[s] <= AIMED}, {s: w for s, w in kept.items() if aimed[s] > AIMED})


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the constant last), mean and scale, by damped Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    if y.min() == y.max():
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        w[-1] = np.log(p / (1 - p))
        return w, mean, scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        w -= 0.7 * np.linalg.solve(h, a.T @ (p - y) / len(y) + ridge * w)
    return w, mean, scale


@dataclass(frozen=True)
class ToxicityModel:
    grammar: Grammar
    weights: tuple[np.ndarray, np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        w, mean, scale = self.weights
        return 1 / (1 + np.exp(-np.clip(_shape(x) @ (w[:-1] / scale) + w[-1] - (mean / scale) @ w[:-1], -40, 40)))


def _shape(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(x[:, :5]), np.log1p(100 * x[:, 5]), (x[:, 0] > 0), (x[:, 0] > 1)])


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """docs: doc_id, text.  Stems and calibration come from at most ``rows`` labelled rows; only features of these come to the driver."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.put(docs.join(F.broadcast(learnable(labels, "toxic", folds, fold, rows)), "doc_id"), "sample")
    grammar = learn_stems(sample)
    schema = ", ".join(f"{f} double" for f in FEATURES) + ", label double"

    def run(parts):
        for batch in parts:
            x = grammar.features(batch.column(0))
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, j]) for j in range(x.shape[1])], batch.column(1)], [*FEATURES, "label"])

    got = sample.select("text", "label").mapInArrow(run, schema).toPandas().sort_values([*FEATURES, "label"])
    scratch.drop("sample")
    x, y = got[list(FEATURES)].to_numpy(), got["label"].to_numpy()
    if not len(y):
        x, y = np.zeros((2, len(FEATURES))), np.array([0.0, 1.0])
    return ToxicityModel(grammar, fit_logistic(_shape(x), y))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and the clause features of each text."""
    schema = "doc_id long, score double, " + ", ".join(f"{f} double" for f in FEATURES)

    def run(parts):
        for batch in parts:
            x = model.grammar.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x)), *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["doc_id", "score", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_rows(table(spark, sf_dir, "documents"))
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "clauses", "softened")
