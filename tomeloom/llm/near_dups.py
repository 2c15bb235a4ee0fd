"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its least
and its greatest, so half the hash evaluations make as many values.  Bands of
values of different permutations bring together what may be alike; a link
counts only after its full shingle sets were compared.

Documents with the same set are one class and take part once.  Buckets of any
size are handled without listing their pairs: all members are first compared
with the bucket's first and last member, and linked classes are merged.  Only
members that are still in different components are compared further: pair by
pair in small buckets, each pair once; in others the members outside the bucket's
largest component go block by block against all members, and only links between
components are given out.

With 20 x 6 permutations (40 bands of 6 values) a pair of similarity s is
compared with probability 1 - (1 - s^6)^40: 0.999995 at 0.8, 1 - 6e-9 at 0.85.

Defined cases: null and empty texts have the empty set and are linked with
nothing; fewer words than a shingle make one shingle; rows without an id are
left out; rows that share an id are one document, so their texts are linked
(but for empty ones); an empty table gives no rows; other columns are ignored
here and passed through by ``keep_one_of_each``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes
from ._base import Scratch, doc_rows, few, table
from .graph import components

SHINGLE_WORDS = 5
PERCENT = 80
GROUPS, ROWS = 20, 6
BLOCK = 256  # sets in a block
BLOCK_SHINGLES = 4096  # sets longer than this on average make smaller blocks
PAIR_ROWS = 256  # most pairs of a bucket that are listed as rows
_RNG = np.random.Generator(np.random.PCG64(20240607))
_XOR = _RNG.integers(0, 2**32, GROUPS * ROWS, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, GROUPS * ROWS, dtype=np.uint32) | np.uint32(1)
_CHUNK = 1 << 16


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, with n + 1 offsets."""
    buf, offs = _bytes.buffers(col)
    low = _bytes.lower(buf)
    start, end, first = _bytes.words(low, offs)
    h = _bytes.span_hash(_bytes.prefix_hash(low), start, end) if len(start) else np.zeros(0, np.uint64)
    x, at = _bytes.shingles(h, first, k)
    sets = [np.unique(x[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    return (np.concatenate(sets) if sets else x), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def min_max(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(sets, 2, GROUPS * ROWS): least and greatest value under each permutation; no set may be empty."""
    n = len(offs) - 1
    out = np.empty((n, 2, len(_XOR)), np.uint32)
    x32 = (x >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < n:  # a chunk fits the processor's cache
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + _CHUNK, "right")) - 1)
        part, at = x32[offs[i] : offs[j]], offs[i:j] - offs[i]
        for p, (flip, mul) in enumerate(zip(_XOR, _MUL, strict=True)):
            v = (part ^ flip) * mul
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            out[i:j, 0, p] = np.minimum.reduceat(v, at)
            out[i:j, 1, p] = np.maximum.reduceat(v, at)
        i = j
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, 2 * GROUPS) keys: the band number and a hash of the band's values."""
    n = len(signature)
    bands = signature.reshape(n, 2 * GROUPS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, 2 * GROUPS + 1, dtype=np.uint64), (n, 2 * GROUPS)).copy()
    for r in range(ROWS):
        key = key * np.uint64(0xC2B2AE3D27D4EB4F) + bands[:, :, r]
    return _bytes.mix(key)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (null for the empty set) and band keys."""

    def run(parts):
        for batch in parts:
            for lo, hi in _bytes.batches(batch.column(2), 1 << 20):
                rows = batch.slice(lo, hi - lo)
                x, offs = shingle_sets(rows.column(2), k)
                size = np.diff(offs)
                full = np.flatnonzero(size)
                keys: list[bytes | None] = [None] * rows.num_rows
                lists: list[np.ndarray | None] = [None] * rows.num_rows
                if len(full):
                    tight = np.concatenate([offs[full], offs[-1:]])
                    bands = band_keys(min_max(x, tight)).astype(np.int64)
                    one, two = np.add.reduceat(_bytes.mix(x), tight[:-1]), np.add.reduceat(_bytes.mix(x ^ _bytes.BYTE_CODE[7]), tight[:-1])
                    raw = np.column_stack([one, two]).tobytes()
                    for n, i in enumerate(full.tolist()):
                        keys[i], lists[i] = raw[16 * n : 16 * n + 16], bands[n]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b of classes, and two longs) whose full sets are similar enough, as those longs; texts: node, text."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("label_a", "label_b", "text_a", "text_b")

    def run(parts):
        for batch in parts:
            for lo, hi in _bytes.batches(batch.column(2), 1 << 20):
                rows = batch.slice(lo, hi - lo)
                xa, at_a = shingle_sets(rows.column(2), k)
                texts_b = rows.column(3).dictionary_encode()  # a bucket's first member comes again and again
                xb, at_b = shingle_sets(texts_b.dictionary, k)
                ok = np.zeros(rows.num_rows, bool)
                for i, j in enumerate(texts_b.indices.to_numpy()):
                    a, b = xa[at_a[i] : at_a[i + 1]], xb[at_b[j] : at_b[j + 1]]
                    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                        continue
                    both = len(a) + len(b) - len(np.union1d(a, b))
                    ok[i] = 100 * both >= percent * (len(a) + len(b) - both)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(keep), rows.column(1).filter(keep)], ["a", "b"])

    return with_b.mapInArrow(run, "a long, b long")


def _late_pairs(apart: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: components linked by a pair of a small bucket."""
    small = apart.where("listed")
    x, y = small.alias("x"), small.alias("y")
    alike = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    rest = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.label") < F.col("y.label")) & alike)
    rest = rest.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"), F.col("y.label").alias("label_a"), F.col("x.label").alias("label_b"))
    return _linked(rest.repartition("a").distinct(), texts, k, percent)


def _late_blocks(apart: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: components linked by members of a larger bucket, one of them outside its largest component.

    The members outside and all members are dealt into blocks; a task has one
    block of each, so a set goes to as many tasks as the other side has blocks.
    """
    wide = F.greatest(F.lit(1.0), F.col("longest") / BLOCK_SHINGLES)  # long sets go fewer to a block
    blocks = lambda n: F.ceil(F.col(n) * wide / BLOCK).cast("int")
    dealt = lambda own, other: F.explode(F.transform(F.sequence(F.lit(0), blocks(other) - 1), lambda j: F.struct(F.pmod(F.xxhash64("node"), blocks(own)).cast("int").alias("own"), j.alias("other"))))
    rows = apart.where("NOT listed")
    y = rows.select("band", "node", "label", F.lit(0).alias("side"), dealt("size", "others").alias("at")).select("band", F.col("at.other").alias("i"), F.col("at.own").alias("j"), "side", "node", "label")
    x = rows.where("label <> major").select("band", "node", "label", F.lit(1).alias("side"), dealt("others", "size").alias("at")).select("band", F.col("at.own").alias("i"), F.col("at.other").alias("j"), "side", "node", "label")

    def compare(group):
        sides = []
        for side in (1, 0):
            part = group.filter(pa.compute.equal(group.column("side"), side))
            if not part.num_rows:
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            values, offs = shingle_sets(part.column("text").combine_chunks(), k)
            sides.append((part.column("label").to_numpy(), np.diff(offs), values, np.repeat(np.arange(len(offs) - 1), np.diff(offs))))
        (lx, nx, vx, dx), (ly, ny, vy, dy) = sides
        common = np.intersect1d(vx, vy)
        hold = []
        for v, d, n in ((vx, dx, len(lx)), (vy, dy, len(ly))):
            at = np.minimum(np.searchsorted(common, v), max(len(common) - 1, 0))
            on = np.flatnonzero(common[at] == v) if len(common) else np.zeros(0, int)
            m = np.zeros((n, len(common)), np.float32)
            m[d[on], at[on]] = 1
            hold.append(m)
        both = (hold[0] @ hold[1].T).astype(np.int64)
        linked = (100 * both >= percent * (nx[:, None] + ny[None, :] - both)) & (lx[:, None] != ly[None, :])
        p, q = np.nonzero(linked)
        pairs = np.unique(np.column_stack([np.maximum(lx[p], ly[q]), np.minimum(lx[p], ly[q])]), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return x.unionByName(y).join(texts, "node").groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the least id that a document is linked with, over any number of links."""
    scratch = Scratch(docs.sparkSession, "neardups")
    rows = doc_rows(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    signed = scratch.put(_signatures(rows, k), "signed")
    own = F.struct(F.col("doc_id").alias("start"), "text_key")
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(own).alias("node"), F.first("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.put(classes, "classes")
    # a class stands for its documents under its least id; an id that several texts share ties their classes
    copies = signed.select("doc_id", "set_key").join(classes.select("set_key", "node.start"), "set_key").where("doc_id <> start")
    copies = scratch.put(copies.select(F.col("doc_id").alias("a"), F.col("start").alias("b")), "copies", F.count("*"))
    n_copies = scratch.observed

    banded = classes.select("node", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head <> tail")
    members = scratch.put(banded.join(buckets, "band"), "members", F.count("*"))
    n_members = scratch.observed
    wanted = members.select(F.col("node.start").alias("doc_id"), F.col("node.text_key").alias("text_key")).distinct()
    texts = rows.join(wanted, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    texts = scratch.put(few(texts.select(F.struct(F.col("doc_id").alias("start"), "text_key").alias("node"), "text"), n_members), "texts")

    # every member against its bucket's first and last
    ends = F.inline(F.array(*[F.struct(F.col("node").alias("a"), F.col(end).alias("b"), F.col("node.start").alias("label_a"), F.col(f"{end}.start").alias("label_b")) for end in ("head", "tail")]))
    first = members.where("node <> head").select(ends).where("a <> b").repartition("a").distinct()
    links = scratch.put(few(_linked(first, texts, k, percent), n_members), "links", F.count("*"))
    n_links = scratch.observed + n_copies
    forest = components(links.unionByName(copies), n_links, scratch, "merge")

    # members of a bucket that are still apart; its first and last have met all others
    labels = forest.select(F.col("node").alias("start"), "root")
    placed = members.withColumn("start", F.col("node.start")).join(labels, "start", "left").select("band", "node", "n", "head", "tail", F.coalesce("root", "start").alias("label"))
    parts = placed.groupBy("band", "label").agg(F.count("*").alias("m"), F.max("n").alias("n"))
    mixed = parts.groupBy("band").agg(F.max_by("label", F.struct("m", "label")).alias("major"), F.max("m").alias("most"), F.sum("m").alias("size"), F.max("n").alias("longest")).where("most < size AND size > 2")
    mixed = mixed.select("band", "major", "size", "longest", (F.col("size") - F.col("most")).alias("others"))
    apart = placed.where("node <> head AND node <> tail").join(mixed, "band").drop("head", "tail").withColumn("listed", F.col("others") * F.col("size") <= PAIR_ROWS)
    apart = scratch.put(few(apart, n_members), "apart", F.struct(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("rest")))
    n_listed, n_rest = scratch.observed["listed"], scratch.observed["rest"]
    late = _late_pairs(apart, texts, k, percent) if n_listed else None
    if n_rest:
        met = _late_blocks(apart, texts, k, percent)
        late = met if late is None else late.unionByName(met)
    if late is not None:
        late = scratch.put(few(late, n_listed + n_rest, 1_000), "late", F.count("*"))
        if scratch.observed:
            forest = components(late.unionByName(forest.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch.observed + n_links, scratch, "top")
    scratch.drop("classes", "copies", "members", "texts", "links", "apart", *(["late"] if late is not None else []))

    found = signed.select("doc_id", "n_shingles").join(forest.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that have the least id of their component, columns as given; of rows that share that id, all."""
    found = near_duplicates(docs, k, percent, id_col=id_col, text_col=text_col)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept.hint("merge"), docs[id_col] == F.col("_kept_id"), "left_semi")


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), k=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
