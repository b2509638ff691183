"""Vectorised text kernels over Arrow string buffers: no Python loop over rows or characters."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about this many bytes, so that a run's arrays (about 20 bytes for each of its bytes) stay small. A longer text is a run
#: of its own, whole: it is the one thing whose memory follows the data, and a text of 100 MB takes about 2 GB.
CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 1 << 13
#: Powers of a base are kept for texts up to this many bytes, and computed anew for longer ones.
KEPT_POWERS = 1 << 20

_RNG = np.random.default_rng(20240229)
BYTE_KEY = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6") if hasattr(ctypes.CDLL("libc.so.6"), "malloc_trim") else None
    except OSError:  # another C library, which keeps its own counsel
        return None


_LIBC: list[ctypes.CDLL | None] = []
_RELEASED = [0.0]


def release(every_s: float = 0.0) -> None:
    """Gives memory that is free back to the system, which a worker that is used again would else hold on to; at most once in every_s seconds."""
    if time.monotonic() - _RELEASED[0] < every_s:
        return
    _RELEASED[0] = time.monotonic()
    if not _LIBC:
        _LIBC.append(_libc())
    pa.default_memory_pool().release_unused()
    if _LIBC[0] is not None:
        _LIBC[0].malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with the worker's free memory given back as it goes and at the end of the partition."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in run(batches):
                yield out
                release(1.0)
        finally:
            release()

    return tidied


def tidy_groups(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run for applyInArrow, with the worker's free memory given back now and then."""

    @wraps(run)
    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release(0.5)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, byte offsets of the rows in them); a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + CHUNK_ROWS)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_table() -> np.ndarray:
    """ASCII letters and digits, and bytes of other characters, stand for themselves; 0 parts words."""
    table = np.zeros(256, np.uint8)
    for span in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
        for b in span:
            table[b] = b
    return table


def space_table() -> np.ndarray:
    """All but ASCII white space stands for itself; 0 parts words."""
    table = np.arange(256, dtype=np.uint8)
    table[[0, 9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
    return table


WORDS, SPACES = word_table(), space_table()


def _spans_table(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for first, last in spans:
        out[first : last + 1] = True
    return out


#: Thai, Lao, Myanmar, Khmer, kana, bopomofo and ideographs: written without spaces, so that each character counts as a word.
_ALONE = _spans_table((0xE01, 0xE7F), (0xE81, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3041, 0x30FF), (0x3105, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x323AF))
#: Spaces and signs beyond ASCII.
_PARTING = _spans_table((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xF0B, 0xF14), (0x104A, 0x104F), (0x1680, 0x1680), (0x17D4, 0x17DA), (0x2000, 0x206F), (0x3000, 0x3004), (0x3008, 0x3020), (0x30A0, 0x30A0), (0x30FB, 0x30FB), (0xFE30, 0xFE4F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
_ALONE &= ~_PARTING


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with 0 between words, starts, ends, offsets of the rows in these) of the words of UTF-8 rows: runs of letters and digits, and each character of a script without spaces."""
    norm = WORDS[data]
    wide = np.flatnonzero((data >= 0xE0) | (data == 0xC2))
    if not len(wide):
        return norm, *tokens(norm, offsets)
    lead = data[wide]
    size = np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2))
    wide, size = wide[wide + size <= len(data)], size[wide + size <= len(data)]
    part = lambda k: data[np.minimum(wide + k, len(data) - 1)].astype(np.int64) & 0x3F
    lead = data[wide].astype(np.int64)
    point = np.where(size == 2, (lead & 0x1F) << 6 | part(1), np.where(size == 3, (lead & 0xF) << 12 | part(1) << 6 | part(2), (lead & 7) << 18 | part(1) << 12 | part(2) << 6 | part(3)))
    point = np.minimum(point, 0x10FFFF)
    gone = _PARTING[point]
    for k in range(4):
        norm[wide[gone & (size > k)] + k] = 0
    alone = _ALONE[point]
    return norm, *tokens(norm, offsets, wide[alone], size[alone])


def tokens(norm: np.ndarray, offsets: np.ndarray, alone: np.ndarray | None = None, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of the rows in these) of the runs of non-zero bytes, none across two rows; what begins at alone, of so many bytes, is a run of its own."""
    size = len(norm)
    is_in = norm != 0
    first, last = is_in.copy(), is_in.copy()
    if size:
        first[1:] &= ~is_in[:-1]
        last[:-1] &= ~is_in[1:]
        begins = offsets[:-1][offsets[:-1] < size]
        first[begins] = is_in[begins]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = is_in[ends]
        if alone is not None and len(alone):
            past = alone + sizes
            first[alone], last[past - 1] = True, True
            before, after = alone[alone > 0] - 1, past[past < size]
            last[before] |= is_in[before]
            first[after] |= is_in[after]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def prefix_sums(norm: np.ndarray) -> np.ndarray:
    """Sums of keyed bytes times powers of BASE, from which span_hash has any span's hash."""
    out = np.zeros(len(norm) + 1, np.uint64)
    np.cumsum(BYTE_KEY[norm] * _powers(BASE, len(norm)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, equal for equal bytes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers(_BASE_INV, len(sums))[starts])


def sequence_sums(values: np.ndarray) -> np.ndarray:
    """As prefix_sums, of 64-bit values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(BASE, len(values)), out=out[1:])
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the rows' offsets in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=count[1:])
    return points, np.minimum(count[offsets], len(points))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums along axis 0 of each row's values; 0 where a row has none."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=out.dtype)
    return out
