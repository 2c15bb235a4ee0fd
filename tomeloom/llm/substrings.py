"""Exact removal of repeated byte strings by refining buckets of q-grams.

Every start of a ``span``-byte string has a bucket, which is refined step by step
by the bucket identifiers of later offsets; only what still shares a bucket goes
on:

1. Each string's least q-gram puts it into a first bucket.  Buckets that no
   earlier document has are singletons, and their strings are done.
2. Long stretches between places picked by their content are compared as
   wholes; a stretch that an earlier document has settles all strings in it.
3. What is left gets bucket identifiers of 8 bytes, the bytes themselves.  A step
   joins a start's identifier with that of a later offset, and the identifiers so
   updated serve the next step: 8 and 8 at +8, 16 and 16 at +16, and so on until
   the last step, whose offset is what ``span`` still lacks.  Starts sorted into
   one bucket then have the same string.  Earlier documents take part with the
   strings of those first buckets that are still asked for.

Documents in order of id are cut into shards of a bounded number of bytes, so
"an earlier document" is an earlier document of the shard, or any document of an
earlier shard.  A shard asks about each identifier once, however many of its
documents hold it; the answer is one bit.  Identifiers of stretches and strings
have 96 bits, of two hashes over all their bytes.  A question goes out for each
shard and bucket of identifiers that has any, so their rows are never more than
the identifiers.

Defined cases: null text is empty; texts shorter than ``span`` keep all bytes;
rows without an id are left out; rows that share an id are not earlier than one
another, and lie in one shard; a document longer than a shard is one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes
from ._base import Scratch, doc_rows, shuffle_partitions, table

SPAN = 50
Q = 24
SHARD_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20  # text whose identifiers meet in one bucket of questions
PART_BYTES = 64 << 20  # text that one task cuts into shards
ANCHOR_ONE_IN = 2
_CHUNK = 1 << 18  # bytes whose identifiers fit the processor's cache
_ZSTD = "zstd"
ROWS = "shard long, kind int, bucket int, a binary, b binary, c binary"
_NAMES = ["shard", "kind", "bucket", "a", "b", "c"]
TEXT, ASKED, ANSWER, STATE, OPEN = range(5)
_OTHER_CODE = np.random.Generator(np.random.PCG64(0x0DD)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every offset on as a number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf),), "<u8", padded.data, strides=(1,)).astype(np.uint64)


def _step(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of what begins with bucket a and has bucket b at a later offset."""
    out = a * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out += b
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(32)
    return out


def _grams(buf: np.ndarray) -> np.ndarray:
    """Identifier of the Q-gram at every offset (len(buf) - Q + 1 of them)."""
    n, eight = len(buf) - Q + 1, _eights(buf)
    return _step(_step(eight[:n], eight[8 : 8 + n]), eight[16 : 16 + n])


def _refined(buf: np.ndarray, span: int) -> np.ndarray:
    """Identifier of the string at every offset (len(buf) - span + 1 of them)."""
    bucket, width = _eights(buf)[: len(buf) - 7], 8
    while width < span:
        later = min(width, span - width)
        bucket, width = _step(bucket[: len(bucket) - later], bucket[later:]), width + later
    return bucket


def _second(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32 bits of another hash of the given byte ranges."""
    return (_bytes.span_hash(_bytes.prefix_hash(buf, _OTHER_CODE), start, end) >> np.uint64(32)).astype(np.uint32)


def _distinct(*keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(np.concatenate([np.zeros(0, np.uint64), *keys]))
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` successive values."""
    size, m = 1, g
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(g) - width + 1], m[width - size : width - size + len(g) - width + 1]) if size < width else m


class Ids:
    """Identifiers of 64 and 32 bits."""

    def __init__(self, key: np.ndarray, more: np.ndarray):
        self.key, self.more = key, more

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """The order that sorts them, and which of the sorted ones differ from the one before."""
        order = np.argsort(self.key, kind="stable")
        k, m = self.key[order], self.more[order]
        same = k[1:] == k[:-1]
        if (m[1:][same] != m[:-1][same]).any():
            order = np.lexsort((self.more, self.key))
            k, m = self.key[order], self.more[order]
            same = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
        return order, np.append(True, ~same)[: len(k)]

    def distinct(self) -> Ids:
        order, new = self.order()
        at = order[new]
        return Ids(self.key[at], self.more[at])

    def among(self, found: Ids) -> np.ndarray:
        """Places of these in the sorted distinct ``found``, all of which it has."""
        at = np.searchsorted(found.key, self.key)
        off = np.flatnonzero(found.more[at] != self.more)
        while len(off):  # other identifiers with the same 64 bits lie beside
            at[off] += 1
            off = off[found.more[at[off]] != self.more[off]]
        return at

    def __len__(self) -> int:
        return len(self.key)


NO_IDS = Ids(np.zeros(0, np.uint64), np.zeros(0, np.uint32))


class Runs:
    """First buckets and stretches of the strings of some documents laid end to end.

    A run is a row of strings with the same least q-gram; a stretch reaches from
    a document's first string or an anchor to the next.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, span: int, stretches: bool):
        none = np.zeros(0, np.int64)
        self.start = self.length = self.seg_start = self.seg_end = none
        self.key = self.seg_key = none.astype(np.uint64)
        self.seg_more = none.astype(np.uint32)
        long = np.diff(offs) >= span
        if not long.any():
            return
        least = _least(_grams(buf), span - Q + 1)
        # offsets where a string starts; a document's first one starts a run
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[offs[:-1][long]] += 1
        edge[offs[1:][long] - span + 1] -= 1
        valid = np.cumsum(edge[:-1], dtype=np.int8).view(bool)[: len(least)]
        head = np.zeros(len(least), bool)
        head[1:] = least[1:] != least[:-1]
        head[offs[:-1][long]] = True
        self.start = np.flatnonzero(head & valid)
        end = np.append(self.start[1:], len(least))
        doc_end = offs[1:][long] - span + 1
        new_doc = np.zeros(len(self.start), bool)
        first = np.searchsorted(self.start, offs[:-1][long])
        new_doc[first] = True
        end[np.append(first[1:], len(self.start)) - 1] = doc_end
        self.length = end - self.start
        self.key = _bytes.mix(least[self.start])
        if stretches:
            cut = np.flatnonzero(new_doc | (self.key % np.uint64(ANCHOR_ONE_IN) == 0))
            self.seg_start, self.seg_end = self.start[cut], end[np.append(cut[1:], len(self.start)) - 1]
            size = (self.seg_end - self.seg_start).astype(np.uint64)
            self.seg_key = _bytes.mix(_bytes.span_hash(_bytes.prefix_hash(buf), self.seg_start, self.seg_end + span - 1) + size)
            self.seg_more = _second(buf, self.seg_start, self.seg_end + span - 1)


def _spread(flags: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Mask of n offsets that the flagged ranges cover; ranges may meet but don't overlap."""
    edge = np.zeros(n + 1, np.int8)
    edge[start[flags]] += 1
    edge[end[flags]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


class Shard:
    """The documents of one shard in order of id, as chunks of bounded size."""

    def __init__(self, ids: np.ndarray, offs: np.ndarray, buf: np.ndarray, span: int):
        self.ids, self.offs, self.buf, self.span = ids, offs, buf, span

    @classmethod
    def unpack(cls, a: bytes, b: bytes, span: int) -> Shard:
        heads = np.frombuffer(b, np.int64)
        n = (len(heads) - 1) // 2
        offs = heads[n:]
        size = int(offs[-1])
        buf = np.frombuffer(pa.decompress(a, size, _ZSTD), np.uint8) if size else np.zeros(0, np.uint8)
        return cls(heads[:n], offs, buf, span)

    def pack(self) -> tuple[bytes, bytes]:
        a = pa.compress(self.buf.tobytes(), _ZSTD, asbytes=True) if len(self.buf) else b""
        return a, np.concatenate([self.ids, self.offs]).astype(np.int64).tobytes()

    def _chunks(self):
        """(from, to, offsets of its texts) of pieces of about _CHUNK bytes: some whole documents, or a part of a long one that shares span - 1 bytes with the next."""
        i, n = 0, len(self.ids)
        while i < n:
            lo, hi = int(self.offs[i]), int(self.offs[i + 1])
            if hi - lo > 2 * _CHUNK:
                for at in range(lo, hi - self.span + 1, _CHUNK):
                    end = min(at + _CHUNK + self.span - 1, hi)
                    yield at, end, np.array([0, end - at])
                i += 1
                continue
            j = min(n, max(i + 1, int(np.searchsorted(self.offs, lo + _CHUNK, "right")) - 1))
            while j > i + 1 and self.offs[j] - self.offs[j - 1] > 2 * _CHUNK:
                j -= 1
            yield lo, int(self.offs[j]), self.offs[i : j + 1] - lo
            i = j

    def runs(self, stretches: bool = True) -> Runs:
        """The runs of all documents, found some documents at a time."""
        parts = []
        for lo, hi, offs in self._chunks():
            part = Runs(self.buf[lo:hi], offs, self.span, stretches)
            part.start, part.seg_start, part.seg_end = part.start + lo, part.seg_start + lo, part.seg_end + lo
            parts.append(part)
        out = Runs(np.zeros(0, np.uint8), np.zeros(1, np.int64), self.span, stretches)
        for name in ("start", "length", "key", "seg_start", "seg_end", "seg_key", "seg_more"):
            setattr(out, name, np.concatenate([getattr(out, name), *[getattr(p, name) for p in parts]]))
        return out

    def string_keys(self, at: np.ndarray) -> Ids:
        """The refined identifiers of the strings that start at the given offsets, which rise."""
        key, more = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for lo in range(0, len(self.buf), _CHUNK):
            part = at[np.searchsorted(at, lo) : np.searchsorted(at, lo + _CHUNK)]
            if len(part):
                piece = self.buf[lo : min(lo + _CHUNK, int(part[-1]) + 1) + self.span - 1]
                key.append(_bytes.mix(_refined(piece, self.span)[part - lo]))
                more.append(_second(piece, part - lo, part - lo + self.span))
        return Ids(np.concatenate(key), np.concatenate(more))

    def doc_rank(self, at: np.ndarray) -> np.ndarray:
        """Rank of the id of the document that holds each offset of the shard; equal ids, equal rank."""
        distinct = np.cumsum(np.append(True, self.ids[1:] != self.ids[:-1])) if len(self.ids) else self.ids
        return distinct[np.searchsorted(self.offs, at, "right") - 1]


def _seen_within(ids: Ids, rank: np.ndarray) -> np.ndarray:
    """Whether an earlier document of the shard has the identifier; ranks don't fall."""
    if not len(ids):
        return np.zeros(0, bool)
    order, first = ids.order()
    lead = rank[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    out = np.empty(len(order), bool)
    out[order] = rank[order] > lead
    return out


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit key; it doesn't fall as keys rise."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ask(shard: int, short: np.ndarray, full: Ids, buckets: int, kind: int = ASKED) -> list[tuple]:
    """Rows that ask, for each bucket that has any, which identifiers an earlier shard has; of the short ones 32 bits beside the bucket's own."""
    in_s, in_f = _bucket_of(short, buckets), _bucket_of(full.key, buckets)
    low = (short & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    present = np.union1d(in_s, in_f)
    cuts = [np.searchsorted(x, present, side).tolist() for x in (in_s, in_f) for side in ("left", "right")]
    return [(shard, kind, b, low[s0:s1].tobytes(), full.key[f0:f1].tobytes(), full.more[f0:f1].tobytes()) for b, s0, s1, f0, f1 in zip(present.tolist(), *cuts, strict=True)]


def _answers(short: np.ndarray, full: Ids, buckets: int, replies: dict[int, tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For sorted identifiers, whether an earlier shard has them."""
    out = []
    for which, keys in enumerate((short, full.key)):
        bucket, seen = _bucket_of(keys, buckets), np.zeros(len(keys), bool)
        for b, bits in replies.items():
            lo, hi = np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right")
            if lo < hi:
                seen[lo:hi] = np.unpackbits(np.frombuffer(bits[which], np.uint8), count=hi - lo).astype(bool)
        out.append(seen)
    return out[0], out[1]


def _arrow(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=_NAMES)


def _first_sight(ids: Ids, sizes: list[int]) -> list[bytes]:
    """Per part (of the given sizes, in shard order) the bits of the identifiers that an earlier part has."""
    order, new = ids.order()
    again = np.empty(len(order), bool)
    again[order] = ~new
    ends = np.cumsum(sizes)
    return [np.packbits(again[e - n : e]).tobytes() for n, e in zip(sizes, ends.tolist(), strict=True)]


def _joined(column: list[bytes], kind: str) -> tuple[np.ndarray, list[int]]:
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column), kind), [len(x) // width for x in column]


def _reply(rows):
    """One bucket: the bits that answer each shard's question."""
    rows = rows.sort_by([("shard", "ascending")])
    shards, bucket = rows.column("shard").to_pylist(), rows.column("bucket")[0].as_py()
    short, n_short = _joined(rows.column("a").to_pylist(), "<u4")
    key, n_full = _joined(rows.column("b").to_pylist(), "<u8")
    more, _ = _joined(rows.column("c").to_pylist(), "<u4")
    said = _first_sight(Ids(short, np.zeros(len(short), np.uint32)), n_short), _first_sight(Ids(key, more), n_full)
    return _arrow([(s, ANSWER, bucket, x, y, b"") for s, x, y in zip(shards, *said, strict=True)])


def _wanted(rows):
    """One bucket: the bits of each shard's first buckets that an open string of it or of a later shard has."""
    rows = rows.sort_by([("shard", "ascending")]).to_pylist()
    still = [r for r in rows if r["kind"] == OPEN]
    keys = np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(r["a"], "<u4") for r in still]])
    by = np.concatenate([np.zeros(0, np.int64), *[np.full(len(r["a"]) // 4, r["shard"]) for r in still]])
    order = np.argsort(keys, kind="stable")
    keys, by = keys[order], by[order]
    out = []
    for r in rows:
        if r["kind"] == ASKED:
            own = np.frombuffer(r["a"], "<u4")
            at = np.searchsorted(keys, own, "right") - 1  # the last shard that has the key open
            wanted = (at >= 0) & (keys[at] == own) & (by[at] >= r["shard"]) if len(keys) else np.zeros(len(own), bool)
            out.append((r["shard"], ANSWER, r["bucket"], np.packbits(wanted).tobytes(), b"", b""))
    return _arrow(out)


def _rows_of(rows: pa.Table) -> tuple[int, dict[int, tuple[bytes, bytes]], dict[int, tuple[bytes, bytes]]]:
    """Shard number, rows by kind (text and state), replies by bucket."""
    single, replies = {}, {}
    for r in rows.to_pylist():
        if r["kind"] == ANSWER:
            replies[r["bucket"]] = (r["a"], r["b"])
        else:
            single[r["kind"]] = (r["a"], r["b"])
    return rows.column("shard")[0].as_py(), single, replies


def _settle(shard: Shard, buckets: int, replies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which strings are repeats by their stretch, which are still open, and the open ones' first buckets."""
    found = shard.runs()
    own_segs = Ids(found.seg_key, found.seg_more)
    runs, segs = _distinct(found.key), own_segs.distinct()
    run_seen, seg_seen = _answers(runs, segs, buckets, replies)
    in_runs = _seen_within(Ids(found.key, np.zeros(len(found.key), np.uint32)), shard.doc_rank(found.start)) | run_seen[np.searchsorted(runs, found.key)]
    in_segs = _seen_within(own_segs, shard.doc_rank(found.seg_start)) | seg_seen[own_segs.among(segs)]
    n = len(shard.buf)
    done = _spread(in_segs, found.seg_start, found.seg_end, n)
    open_ = _spread(in_runs, found.start, found.start + found.length, n) & ~done
    still = np.logical_or.reduceat(open_, found.start) & in_runs if len(found.start) else in_runs
    return done, open_, _distinct(found.key[still])


def _pack_masks(*masks: np.ndarray) -> list[bytes]:
    return [pa.compress(np.packbits(x).tobytes(), _ZSTD, asbytes=True) if len(x) else b"" for x in masks]


def _masks(state: tuple[bytes, bytes], n: int) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(pa.decompress(x, -(-n // 8), _ZSTD), np.uint8), count=n).astype(bool) if n else np.zeros(0, bool) for x in state]


def _shards(rows: DataFrame, n_bytes: int, span: int, buckets: int) -> DataFrame:
    """The texts in order of id as shards of about SHARD_BYTES, cut where the id changes, with their first questions."""

    def ask(number: int, ids: list, texts: list) -> pa.RecordBatch:
        buf, offs = _bytes.buffers(pa.chunked_array(texts).cast(pa.large_string()))
        shard = Shard(np.concatenate(ids), offs, buf, span)
        found = shard.runs()
        out = [(number, TEXT, -1, *shard.pack(), b""), *_ask(number, _distinct(found.key), Ids(found.seg_key, found.seg_more).distinct(), buckets)]
        return _arrow(out).combine_chunks().to_batches()[0]

    def cut(batches):
        number, held, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            doc_ids, (_, offs) = batch.column(0).to_numpy(), _bytes.buffers(batch.column(1))
            i = 0
            while i < batch.num_rows:
                if held >= SHARD_BYTES and ids[-1][-1] != doc_ids[i]:
                    yield ask(number, ids, texts)
                    number, held, ids, texts = number + 1, 0, [], []
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(offs, offs[i] + SHARD_BYTES - held, "right"))))
                while j < batch.num_rows and doc_ids[j] == doc_ids[j - 1]:
                    j += 1
                ids.append(doc_ids[i:j]), texts.append(batch.column(1).slice(i, j - i))
                held += int(offs[j] - offs[i])
                i = j
        if ids:
            yield ask(number, ids, texts)

    parts = max(1, -(-n_bytes // PART_BYTES), min(shuffle_partitions(rows.sparkSession), -(-n_bytes // SHARD_BYTES)))
    return rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(cut, ROWS)


def remove_repeated_strings(docs: DataFrame, span: int = SPAN, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every document."""
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = doc_rows(docs, id_col, text_col)
    n_bytes = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = max(1, -(-n_bytes // BUCKET_BYTES), min(shuffle_partitions(docs.sparkSession), -(-n_bytes // SHARD_BYTES)))

    first = scratch.put(_shards(rows, n_bytes, span, buckets), "shards", by=("kind",))
    texts = first.where(F.col("kind") == TEXT)
    answer = lambda asked: asked.where(F.col("kind") == ASKED).groupBy("bucket").applyInArrow(_reply, ROWS)
    replies = scratch.put(answer(first), "replies")

    def settle(key, group):
        number, single, got = _rows_of(group)
        shard = Shard.unpack(*single[TEXT], span)
        done, open_, keys = _settle(shard, buckets, got)
        return _arrow([(number, STATE, -1, *_pack_masks(done, open_), b""), *_ask(number, keys, NO_IDS, buckets, OPEN)])

    settled = scratch.put(texts.unionByName(replies).groupBy("shard").applyInArrow(settle, ROWS), "settled")
    scratch.drop("replies")
    asked = first.where(F.col("kind") == ASKED).withColumn("b", F.lit(None).cast("binary")).withColumn("c", F.lit(None).cast("binary"))
    wanted = scratch.put(asked.unionByName(settled.where(F.col("kind") == OPEN)).groupBy("bucket").applyInArrow(_wanted, ROWS), "wanted")
    scratch.drop(f"shards/kind={ASKED}")

    def refine(key, group):
        number, single, got = _rows_of(group)
        shard = Shard.unpack(*single[TEXT], span)
        done, open_ = _masks(single[STATE], len(shard.buf))
        found = shard.runs(stretches=False)
        runs = _distinct(found.key)
        want, _ = _answers(runs, NO_IDS, buckets, got)
        part = (open_ | _spread(want[np.searchsorted(runs, found.key)], found.start, found.start + found.length, len(open_))) & ~done
        ids = shard.string_keys(np.flatnonzero(part)).distinct()
        return _arrow([(number, STATE, -1, *_pack_masks(done, part), b""), *_ask(number, _NO_KEYS, ids, buckets)])

    state = settled.where(F.col("kind") == STATE)
    refined = scratch.put(texts.unionByName(state).unionByName(wanted).groupBy("shard").applyInArrow(refine, ROWS), "refined", by=("kind",))
    scratch.drop("settled", "wanted")
    last = scratch.put(answer(refined), "last-replies")
    scratch.drop(f"refined/kind={ASKED}")

    def finish(key, group):
        _, single, got = _rows_of(group)
        shard = Shard.unpack(*single[TEXT], span)
        repeat, part = _masks(single[STATE], len(shard.buf))
        at = np.flatnonzero(part)
        ids = shard.string_keys(at)
        distinct = ids.distinct()
        _, seen = _answers(_NO_KEYS, distinct, buckets, got)
        if len(at):
            repeat[at] |= _seen_within(ids, shard.doc_rank(at)) | seen[ids.among(distinct)]
        return _results(shard, repeat, span, keep_text)

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    state = refined.where(F.col("kind") == STATE)
    return texts.unionByName(state).unionByName(last).groupBy("shard").applyInArrow(finish, out)


_NO_KEYS = np.zeros(0, np.uint64)


def _covered(repeat: np.ndarray, span: int) -> np.ndarray:
    """Bytes under any string that starts at a marked offset."""
    out = np.zeros(len(repeat), bool)
    for lo in range(0, len(repeat), _CHUNK):
        before = max(0, lo - span + 1)
        marks = np.concatenate([np.zeros(span, np.int32), np.cumsum(repeat[before : lo + _CHUNK], dtype=np.int32)])
        out[lo : lo + _CHUNK] = (marks[span:] > marks[:-span])[lo - before :]
    return out


def _results(shard: Shard, repeat: np.ndarray, span: int, keep_text: bool) -> pa.Table:
    """Bytes under any repeated string go; strings never reach over a document's end."""
    raw, gone = shard.buf, _covered(repeat, span)
    n_gone, n_rise, kept, digests = [], [], [], []
    for a, b in zip(shard.offs[:-1].tolist(), shard.offs[1:].tolist(), strict=True):
        out = gone[a:b]
        n_gone.append(int(np.count_nonzero(out)))
        left = raw[a:b]
        if n_gone[-1]:
            n_rise.append(int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1])))
            left = left[~out]
        else:
            n_rise.append(0)
        digests.append(hashlib.sha256(left).hexdigest())
        if keep_text:
            kept.append(left.tobytes())
    cols = {"doc_id": pa.array(shard.ids, pa.int64()), "n_bytes": pa.array(np.diff(shard.offs), pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "n_spans": pa.array(n_rise, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    return pa.table(cols | ({"kept": pa.array(kept, pa.binary())} if keep_text else {}))


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(table(spark, sf_dir, "documents"))
