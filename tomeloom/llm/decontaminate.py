"""Benchmark decontamination by spaced seeds.

Fixed masks look at some of the words of a window and ignore the others, so a
window still hits after words at ignored places were substituted.  Windows of
documents are looked up among those of the benchmark; around each hit the
document and the item are laid side by side, and the stretch of enough words
that has the most equal ones to spare is verified on all of its words.

The benchmark is a stated query set: it is dealt into blocks of a bounded size,
and each block is shipped to the executors and meets every document.  With more
than one, a block's result is written before the next one is read, so that the
driver and the executors hold one block at a time.

Words are compared without case and outer punctuation.  An overlap counts from
``least_words`` words on (the whole item if that is shorter, five words at
least) with at least ``similarity`` of them equal; it starts and ends with equal
words, unless it is the whole of a short item.  What stands beside it on the same
diagonal can't hide it.

No pattern of substitutions that the rule allows is without a hit.  Of 12 words
or more at 0.8, some four neighbours are equal, but for 15 words in four runs of
three, which the second mask hits.  A shorter item is cut into two parts more
than it may have substitutions; its masks leave out all choices of that many.

Defined cases: null and empty texts have no overlap; items of fewer than five
words never match; an empty benchmark matches nothing; items without an id or
text are left out, and by the query documents without an id; repeated items are
reported once, repeated documents each; a very long text is read as any other;
columns of documents pass through whatever their names, but for that of the
result, which is an error.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes
from ._base import Scratch, table, whole_text
from .toxicity import _strip, fold

# 1 marks a word that is looked at.
MASKS = ("1111", "1110111")
LEAST_WORDS = 12
SHORTEST_ITEM = 5
SIMILARITY = 0.8
BLOCK_BYTES = 8 << 20
CHUNK_WORDS = 1 << 20
_TABLE_BITS = 20
OVERLAP = "struct<item_id:bigint,item_start:int,doc_start:int,length:int,matches:int>"
_OVERLAP_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32()), ("matches", pa.int32())]))


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text, and the index of each text's first word (n + 1)."""
    buf, offs = _bytes.buffers(col)
    low = fold(buf)
    start, end, first = _bytes.words(low, offs)
    if not len(start):
        return np.zeros(0, np.uint64), first
    return _bytes.span_hash(_bytes.prefix_hash(low), *_strip(low, start, end)), first


def _window_keys(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(n, salt + 1, np.uint64)
    for o, c in enumerate(mask):
        if c == "1":
            key = key * np.uint64(0xC2B2AE3D27D4EB4F) + h[o : o + n]
    return _bytes.mix(key)


def _parts(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction."""
    return Fraction(similarity).limit_denominator(1000).as_integer_ratio()


def long_masks(least: int, similarity: float) -> tuple[str, ...]:
    """Masks that hit every overlap of ``least`` words or more: MASKS, or for laxer rules the run of equal words that each overlap has."""
    if least >= LEAST_WORDS and similarity >= SIMILARITY:
        return MASKS
    num, den = _parts(similarity)
    spoilt = {n: (den - num) * n // den for n in range(least, 10 * least)}
    return ("1" * max(1, min(-(-(n - k) // (k + 1)) for n, k in spoilt.items())),)


def short_masks(n: int, similarity: float) -> list[str]:
    """Masks of n words of which one hits whatever the words that ``similarity`` lets differ."""
    num, den = _parts(similarity)
    k = (den - num) * n // den
    parts = min(n, k + 2)
    return ["".join("0" if i * parts // n in out else "1" for i in range(n)) for out in combinations(range(parts), k)]


class Seeds:
    """The windows of one block of benchmark items under every mask."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST_WORDS, similarity: float = SIMILARITY):
        self.ids = [i for i, _ in items]
        self.least, self.similarity = least, similarity
        self.flat, self.first = word_hashes(pa.array([t for _, t in items], pa.string()))
        self.words = [self.flat[self.first[i] : self.first[i + 1]] for i in range(len(items))]
        span = max(SHORTEST_ITEM, min(least, LEAST_WORDS))
        long = long_masks(span, similarity)
        short = {n: short_masks(n, similarity) for n in sorted({len(w) for w in self.words if SHORTEST_ITEM <= len(w) < span})}
        self.masks: list[str] = list(dict.fromkeys([*long, *(m for ms in short.values() for m in ms)]))
        salt = {mask: m for m, mask in enumerate(self.masks)}
        keys, item, at = [], [], []
        for no, w in enumerate(self.words):
            for mask in long if len(w) >= span else short.get(len(w), ()):
                k = _window_keys(w, mask, salt[mask])
                keys.append(k), item.append(np.full(len(k), no)), at.append(np.arange(len(k)))
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        order = np.argsort(k := cat(keys, np.uint64), kind="stable")
        self.keys, self.item, self.at = k[order], cat(item, np.int64)[order], cat(at, np.int64)[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - _TABLE_BITS)] = True

    def _hits(self, h: np.ndarray, first: np.ndarray):
        """document, item, shift and place in the document of all hits, a bounded number of the items' words at a time."""
        doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        size = np.concatenate([[0], np.cumsum(np.diff(self.first)[self.item])])
        for m, mask in enumerate(self.masks):
            keys = _window_keys(h, mask, m)
            if not len(keys):
                continue
            at = np.flatnonzero(self.table[keys >> np.uint64(64 - _TABLE_BITS)])
            at = at[doc_of[at] == doc_of[at + len(mask) - 1]]
            lo, hi = np.searchsorted(self.keys, keys[at]), np.searchsorted(self.keys, keys[at], "right")
            at, lo, hi = at[lo < hi], lo[lo < hi], hi[lo < hi]
            upto = np.cumsum(size[hi] - size[lo])
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK_WORDS, "right")))
                n = hi[i:j] - lo[i:j]
                of = np.repeat(np.arange(i, j), n)
                k = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                d = doc_of[at[of]]
                place = at[of] - first[d]
                yield d, self.item[k], place - self.at[k], place
                i = j

    def overlaps(self, h: np.ndarray, first: np.ndarray) -> dict[int, list[tuple]]:
        """By document: its verified overlaps."""
        found: dict[int, set[tuple]] = {}
        for hits in self._hits(h, first):
            order = np.lexsort(hits[::-1])
            d, no, shift, place = (x[order] for x in hits)
            new = np.flatnonzero(np.diff(d, prepend=-1) | np.diff(no, prepend=-1) | (np.diff(shift, prepend=0) != 0))
            upto = np.append(new[1:], len(d))
            lo = np.maximum(0, -shift[new])
            n_item = np.diff(self.first)[no[new]]
            hi = np.minimum(n_item, np.diff(first)[d[new]] - shift[new])
            able = np.flatnonzero(self._may_hold(h, first[d[new]] + shift[new], no[new], lo, hi))
            for g in able.tolist():
                doc, item, s, a0, n = int(d[new[g]]), int(no[new[g]]), int(shift[new[g]]), int(lo[g]), int(n_item[g])
                equal = self.words[item][a0 : hi[g]] == h[first[doc] + a0 + s : first[doc] + hi[g] + s]
                for a, b in self._stretches(equal, n, place[new[g] : upto[g]] - s - a0):
                    matches = int(equal[a:b].sum())
                    if b - a >= max(SHORTEST_ITEM, min(self.least, n)) and matches >= self.similarity * (b - a) - 1e-9:
                        found.setdefault(doc, set()).add((item, s, a0 + a, b - a, matches))
        return {d: list(dict.fromkeys((self.ids[no], a, a + s, n, m) for no, s, a, n, m in sorted(v))) for d, v in sorted(found.items())}

    def _may_hold(self, h: np.ndarray, start: np.ndarray, no: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether a diagonal holds a stretch of enough words, enough of them equal."""
        least = np.maximum(SHORTEST_ITEM, np.minimum(self.least, np.diff(self.first)[no]))
        may = hi - lo >= least
        on = np.flatnonzero(may)
        if not len(on):
            return may
        n = (hi - lo)[on]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = self.flat[np.repeat(self.first[no[on]] + lo[on], n) + step] == h[np.repeat(start[on] + lo[on], n) + step]
        whole = np.diff(self.first)[no[on]] <= self.least
        # running sums with one place more for each diagonal's end
        of, at = np.repeat(np.arange(len(n)), n + 1), np.cumsum(n + 1) - n - 1
        inner = np.ones(len(of), bool)
        inner[at + n] = False
        num, den = _parts(self.similarity)
        gain = np.zeros(len(of), np.int64)
        gain[inner] = np.where(equal, den - num, -num)
        total = np.cumsum(gain) - gain
        begins, ends = np.zeros(len(of), bool), np.zeros(len(of), bool)
        begins[inner] = equal
        ends[1:] = begins[:-1]
        # each diagonal lies lower than the one before, so that the least of those up to a place is its own if it has any
        total -= of * (int(np.abs(gain).sum()) + 1)
        lowest = np.minimum.accumulate(np.where(begins, total, np.iinfo(np.int64).max))
        back = np.arange(len(of)) - least[on][of]
        holds = ends & (back >= 0) & (total >= lowest[np.maximum(back, 0)])
        may[on] = np.where(whole, total[at + n] >= total[at], np.logical_or.reduceat(holds, at))
        return may

    def _stretches(self, equal: np.ndarray, n_item: int, places: np.ndarray) -> list[tuple[int, int]]:
        """The stretches to verify: the whole of a short item, else the best one around each run of equal words that was hit."""
        if n_item <= self.least:
            return [(0, len(equal))]
        _, one = np.unique(np.cumsum(~equal)[places], return_index=True)
        return [_best_stretch(equal, p, self.least, self.similarity) for p in places[one].tolist()]


def _best_stretch(equal: np.ndarray, inside: int, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> tuple[int, int]:
    """The stretch of ``least`` words or more, from an equal word to an equal word, that holds place ``inside`` and has the most equal words beyond those that ``similarity`` asks for; empty if there is none."""
    num, den = _parts(similarity)
    total = np.concatenate([[0], np.cumsum(np.where(equal, den - num, -num))])
    far = np.iinfo(np.int64).max // 2
    least = min(least, len(equal))
    begin = np.where(equal[: inside + 1], total[: inside + 1], far)
    ends = np.arange(max(inside + 1, least), len(equal) + 1)
    if not len(ends):
        return inside, inside
    gain = np.where(equal[ends - 1], total[ends], -far) - np.minimum.accumulate(begin)[np.minimum(inside, ends - least)]
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))
    if gain[best] < 0:
        return inside, inside
    b = int(ends[best])
    return int(np.argmin(begin[: b - least + 1])), b


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    """The benchmark's items, a block of about BLOCK_BYTES at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).dropna().distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // BLOCK_BYTES))
    if not size:
        return
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield sorted((r[0], r[1]) for r in items.where(block == i).collect())


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, id_col: str = "item_id", item_text_col: str = "text", text_col: str = "text", out_col: str = "overlaps") -> DataFrame:
    """docs with an array of the verified overlaps of each text."""
    if out_col in docs.columns:
        raise ValueError(f"documents have a column {out_col} already")
    scratch = Scratch(docs.sparkSession, "overlaps")
    out, held = docs, None
    for i, items in enumerate(_blocks(benchmark, id_col, item_text_col)):
        if held is not None:
            out = scratch.put(out, f"block{i}")
            scratch.drop(f"block{i - 1}")
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(items)  # about BLOCK_BYTES
        out = _with_block(out, held, least_words, similarity, text_col, out_col, i == 0)
    return docs.withColumn(out_col, F.array().cast(f"array<{OVERLAP}>")) if held is None else out


def _with_block(docs: DataFrame, held, least: int, similarity: float, text_col: str, out_col: str, fresh: bool) -> DataFrame:
    at = docs.columns.index(text_col)
    names = docs.columns if fresh else docs.columns[:-1]

    def run(parts):
        seeds = Seeds(held.value, least, similarity)
        for batch in parts:
            for lo, hi in _bytes.batches(batch.column(at)):
                rows = batch.slice(lo, hi - lo)
                got = seeds.overlaps(*word_hashes(rows.column(at)))
                old = [[]] * rows.num_rows if fresh else [[tuple(x.values()) for x in v] for v in rows.column(len(names)).to_pylist()]
                lists = [[dict(zip(("item_id", "item_start", "doc_start", "length", "matches"), x, strict=True)) for x in [*old[i], *got.get(i, [])]] for i in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], pa.array(lists, _OVERLAP_ARROW)], [*names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return docs.mapInArrow(run, f"{schema}, `{out_col}` array<{OVERLAP}>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a verified overlap, columns as given."""
    out_col = "_overlaps"
    while out_col in docs.columns:
        out_col = f"_{out_col}"
    return find_overlaps(docs, benchmark, out_col=out_col, **options).where(F.size(out_col) == 0).drop(out_col)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).where("doc_id IS NOT NULL")
    found = find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.size("overlaps").alias("n_overlaps"), "overlaps")
