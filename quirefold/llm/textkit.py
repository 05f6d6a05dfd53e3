"""Array kit for whole texts: bytes of a batch laid end to end, word and line spans, 64-bit hashes of spans.

Everything works on UTF-8 bytes. White space is always the fixed ASCII set 0x20 and 0x09-0x0D, and only A-Z is
lower-cased, so cutting and folding bytes is the same as cutting and folding characters. Texts are taken whole; a batch
is handled in slices of bounded bytes, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc



def return_memory() -> None:
    """Workers are reused by later stages: arrays over a megabyte are mapped on their own, so that they go back to the
    system when they are freed, and Arrow's batches too. Only workers do this, when they cut their first batch or ask; elsewhere
    than on glibc nothing is changed."""
    from pyspark import TaskContext

    if _returned or TaskContext.get() is None:
        return
    _returned.append(True)
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        m_mmap_threshold = -3
        mallopt(m_mmap_threshold, 1 << 20)
        pa.set_memory_pool(pa.system_memory_pool())


_returned: list[bool] = []

#: Under 2**20 with the gaps, so that the power tables below have that many entries. Arrays over a slice take 8 bytes for
#: each of its bytes, and an operator may hold a dozen of them.
SLICE_BYTES = 950_000
U64 = np.uint64
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15 | 1

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (in a new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Two families of polynomial hashes, independent of each other.
_STEPS = (_STEP, 0xD1342543DE82EF95 | 1)
_BYTES = tuple(mix((np.arange(256, dtype=U64) + U64(1)) * U64(step)) for step in _STEPS)
_powers: list[list[np.ndarray]] = [[np.ones(1, dtype=U64), np.ones(1, dtype=U64)] for _ in _STEPS]


def _power_tables(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd step and of its inverse modulo 2**64, grown on demand."""
    own = _powers[family]
    if len(own[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((_STEPS[family], pow(_STEPS[family], -1, 1 << 64))):
            out = np.empty(size, dtype=U64)
            out[0] = 1
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * U64(pow(base, have, 1 << 64))
                have *= 2
            own[k] = out
    return own[0], own[1]


def prefix_sums(data: np.ndarray, family: int = 0) -> np.ndarray:
    """Running polynomial sums of the bytes, one longer than data."""
    up, _ = _power_tables(len(data) + 1, family)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTES[family][data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hash of each span [start, end); equal bytes give equal hashes wherever they stand."""
    _, down = _power_tables(len(sums), family)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def lay(texts: list[bytes | None], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with one gap byte after each; where each text starts and ends. Null is empty."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(gap.join([t or b"" for t in texts]) + gap, dtype=np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    return data, starts, starts + sizes


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that are not white space."""
    space = np.ones(len(data) + 2, dtype=np.int8)
    space[1:-1] = IS_SPACE[data]
    edges = np.flatnonzero(np.diff(space))
    return edges[0::2], edges[1::2]


def owner(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position."""
    return np.searchsorted(starts, positions, side="right") - 1


def gram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive values (len - n + 1 of them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(m, (seed * 0xA24BAED4963EE407 + n) & _MASK, dtype=U64)
    for k in range(n):
        out *= U64(0x9FB21C651E98DF25)
        out += hashes[k : m + k]
        out ^= out >> U64(29)
    return mix(out)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a slice holds about limit bytes of the column, or one longer text."""
    return_memory()
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = total[at] - sizes[at]
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def in_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from slices(batch, column, limit)
