"""Best-fit packing of tokenised documents, certified by lower bounds.

Every document becomes token ids and one end id; one longer than a sequence is
cut, its first piece taking the odd length.  Pieces are dealt out to groups,
each packed best-fit decreasing.  Dual-feasible functions give a lower bound of
each group's bin count: a group that meets it is done, and one with a gap gives
the pieces of its emptiest bins up.  What several such groups gave up is packed
together again, round after round, until no gap is left or one group remains.
A round that would need more bins than it was given keeps the bins as they were.

Defined cases: null and empty texts are the end id alone; rows without an id are
left out; repeated rows are packed each on their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, doc_rows, shuffle_partitions, table

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 20_000
POOL = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level vocabulary as a ``tokenizers`` file, and the same one as ranks with the pattern that splits words."""

    tokenizer: str
    ranks: str
    pattern: str


class Encoder:
    """Token ids as little-endian bytes.

    The ids are those of the ``tokenizers`` file.  They come from the ranks of the
    same vocabulary, which take a tenth of the time (the tests hold them against
    the file on 100,000 random texts); texts with the string of a special token,
    which ranks don't know, go through the file.
    """

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken
        from tokenizers import Tokenizer

        self.file = Tokenizer.from_file(vocabulary.tokenizer)
        self.special = [t.content for t in self.file.get_added_tokens_decoder().values()]
        with open(vocabulary.ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        special = any(x in text for x in self.special)
        ids = self.file.encode(text, add_special_tokens=False).ids if special else self.ranks.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


_ENCODERS: dict[Vocabulary, Encoder] = {}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; an odd length comes first."""
    if n <= capacity:
        return [(0, n)]
    odd = n % capacity
    return ([(0, odd)] if odd else []) + [(i, capacity) for i in range(odd, n, capacity)]


def token_pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(parts):
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(vocabulary)
        encoder = _ENCODERS[vocabulary]
        end = np.array([END_ID], "<u4").tobytes()
        for batch in parts:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                out: list[tuple] = []
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text) + end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        out.append((doc_id, piece, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of several dual-feasible bounds of the number of bins."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    w = np.flatnonzero(count)
    n = count[w]
    best = -(-int((w * n).sum()) // capacity)
    for k in range(1, 21):  # u_k: rounds each size to a multiple of 1 / k unless it is one of 1 / (k + 1)
        scaled = (k + 1) * w
        value = np.where(scaled % capacity == 0, w * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    for small in w[w <= capacity // 2]:  # U_eps: large sizes fill a bin, small ones vanish
        value = np.where(w > capacity - small, capacity, np.where(w < small, 0, w))
        best = max(best, -(-int((value * n).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item.

    Open bins are kept by room left; a bit set of the rooms in use gives the
    tightest bin that still fits.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use, n_bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = in_use >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                in_use &= ~(1 << room)
        else:
            room, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            by_room[room - size].append(b)
            in_use |= 1 << (room - size)
    return bins, offsets


def _pack_group(capacity: int, last: bool):
    def run(key, pdf):
        """Adds bin, offset and whether the piece is given up; old_bin < 0 in the first round."""
        pdf = pdf.drop(columns="group").sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n_bins = int(bins.max()) + 1
        old = pdf["sequence_id"]
        if (old >= 0).all() and n_bins > old.nunique():
            bins, offsets = pd.factorize(old)[0], pdf["offset"].to_numpy()
            n_bins = int(bins.max()) + 1
        gap = n_bins - lower_bound(lengths, capacity)
        free = capacity - np.bincount(bins, weights=lengths, minlength=n_bins)
        given = np.zeros(n_bins, bool)
        if not last:  # the emptiest bin of a certified group too: its sum is rounded up
            given[np.argsort(-free, kind="stable")[: 2 * gap + (2 if gap else 1)]] = True
            given &= free > 0
        pdf["sequence_id"] = (np.int64(key[0]) << 32) + bins
        pdf["offset"] = offsets
        pdf["given_up"] = given[bins]
        return pdf

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (with an integer ``length`` of at most capacity) and their sequence_id and offset."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "pack")
    n = pieces.count()
    groups = max(1, min(max(shuffle_partitions(spark), -(-n // group_pieces)), -(-n // 2000)))
    todo = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups))).withColumn("sequence_id", F.lit(-1).cast("long")).withColumn("offset", F.lit(-1).cast("long"))
    done, level = None, 0
    while True:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.drop("group").schema) + ", given_up boolean"
        # the level in the high bits keeps sequence numbers of the rounds apart
        keyed = todo.withColumn("group", F.col("group") + F.lit(level << 26))
        packed = scratch.put(keyed.groupBy("group").applyInPandas(_pack_group(capacity, groups == 1), schema), f"round{level}")
        kept = packed.where("NOT given_up").drop("given_up")
        done = kept if done is None else done.unionByName(kept)
        if groups == 1:
            return done
        groups, level = -(-groups // POOL), level + 1
        todo = packed.where("given_up").drop("given_up").withColumn("group", F.pmod(F.floor(F.shiftright("sequence_id", 32).bitwiseAND(F.lit((1 << 26) - 1)) / POOL), F.lit(groups)))


def pack_documents(docs: DataFrame, words: Vocabulary, capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every document's pieces."""
    scratch = Scratch(docs.sparkSession, "tokens")
    pieces = scratch.put(token_pieces(doc_rows(docs, id_col, text_col), words, capacity), "pieces")
    return pack(pieces, capacity)


def vocabulary() -> Vocabulary:
    """The tokenizer file that fixes the ids, and its vocabulary as ranks."""
    import public_tokenizers

    return Vocabulary(str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
