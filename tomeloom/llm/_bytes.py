"""numpy kernels over the raw UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POW: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        m = 1 << (n - 1).bit_length()
        for key, b in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _POW[key] = np.multiply.accumulate(p)
    return _POW["up"], _POW["down"]


def prefix_hash(buf: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any span; ``code`` has a number for each byte."""
    up, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(code[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes, equal hash."""
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of each document, and the index of each document's first word (n + 1)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offs)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each document (all words of a shorter one as one run), with n + 1 offsets; in text order, repeated ones kept."""
    n_words = np.diff(first)
    n_out = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(n_out)])
    out = np.zeros(offs[-1], np.uint64)
    if not len(out):
        return out, offs
    doc = np.repeat(np.arange(len(n_words)), n_out)
    at = np.arange(len(out)) - offs[doc] + first[doc]
    left = n_words[doc]
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        step = padded[at + j]
        if j:
            step = np.where(left > j, step, np.uint64(j))
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + step
    return mix(out), offs


def batches(col: pa.Array, limit: int = 4_000_000):
    """(from, to) row ranges with about ``limit`` bytes each, one row at least."""
    _, offs = buffers(col) if len(col) else (None, np.zeros(1, np.int64))
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j
