"""Vectorized helpers over text columns held as one byte buffer with offsets.

All functions work on the UTF-8 bytes of a whole Arrow batch at once, so a
task spends its time in numpy and not in a Python loop over rows. Hashes are
polynomials modulo 2**64 over random byte values, taken from prefix sums, so
that any window costs the same whatever its length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # rows handled at once; bounds a task's scratch arrays
PIECE_BYTES = 256 << 10  # bytes hashed at once, also within a row

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# words separated by white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

# words of letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[128:] = True

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix finalizer)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUES = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, hence invertible
POWER_STEP = 1 << 16


def _powers(p: int) -> tuple[np.ndarray, int]:
    """p**k modulo 2**64 for k < POWER_STEP, and p**POWER_STEP."""
    a = np.full(POWER_STEP, p, dtype=U64)
    a[0] = 1
    return np.multiply.accumulate(a), pow(p, POWER_STEP, 1 << 64)


POWERS = [_powers(p) for p in MULTIPLIERS]
INVERSES = [_powers(pow(p, -1, 1 << 64)) for p in MULTIPLIERS]


def inverse_powers(which: int, places: np.ndarray) -> np.ndarray:
    """P**-k for each place k; tables of POWER_STEP entries, however long the text."""
    low, step = INVERSES[which]
    out = low[places & (POWER_STEP - 1)]
    high = places // POWER_STEP
    most = int(high.max()) if len(high) else 0
    if most:
        far = np.full(most + 1, step, dtype=U64)
        far[0] = 1
        out = out * np.multiply.accumulate(far)[high]
    return out


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums that window_hash reads; one longer than ``values``."""
    out = np.zeros(len(values) + 1, dtype=U64)
    low, step = POWERS[which]
    scale = 1
    for at in range(0, len(values), POWER_STEP):
        part = values[at:at + POWER_STEP]
        np.cumsum(part * (low[:len(part)] * U64(scale)), out=out[at + 1:at + 1 + len(part)])
        out[at + 1:at + 1 + len(part)] += out[at]
        scale = scale * step % (1 << 64)
    return out


def window_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each window, whatever its place."""
    h = pre[ends] - pre[starts]
    return mix64(h * inverse_powers(which, starts) + (ends - starts).astype(U64))


def buffer_of(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    if not (pa.types.is_large_binary(col.type) or pa.types.is_binary(col.type)):
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    wide = pa.types.is_large_binary(col.type)
    n = len(col)
    _, off, data = col.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``size`` bytes each (one row at least)."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def pieces(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray, size: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, row of each piece): rows longer than ``size`` are cut at the
    next place behind every ``size`` bytes that lies in no word."""
    long = np.flatnonzero(np.diff(offs) > size)
    if not len(long):
        return offs, np.arange(len(offs) - 1)
    cuts = []
    for r in long.tolist():
        at, end = int(offs[r]) + size, int(offs[r + 1])
        while at < end:
            free = np.flatnonzero(~is_word[buf[at:min(end, at + size)]])
            if len(free):
                cuts.append(at + int(free[0]))
                at = cuts[-1] + size
            else:
                at += size
    both = np.concatenate((offs, np.array(cuts, np.int64)))
    order = np.argsort(both, kind="stable")  # a cut never equals an offset
    at, row = both[order], np.cumsum(order < len(offs))[:-1] - 1
    return at, row


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of every word; a word never crosses rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = is_word[buf]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    edges = offs[(offs > 0) & (offs < len(buf))]
    before[edges] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return window_hash(prefix(BYTE_VALUES[buf], which), starts, ends, which)


def hashed_words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray, which: int = 0, fold: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(starts, ends, row, hash) of every word, PIECE_BYTES at once, so that a
    long text costs little more than its words. ``fold`` maps bytes first."""
    at, row_of = pieces(buf, offs, is_word if fold is None else is_word[fold], PIECE_BYTES)
    z = np.zeros(0, np.int64)
    got = [(z, z, z, z.astype(U64))]
    for i, j in slices(at, PIECE_BYTES):
        base = at[i]
        part = buf[base:at[j]] if fold is None else fold[buf[base:at[j]]]
        s, e, piece = words(part, at[i:j + 1] - base, is_word)
        got.append((s + base, e + base, row_of[i + piece], word_hashes(part, s, e, which)))
    return tuple(np.concatenate(x) for x in zip(*got))


def give_back() -> None:
    """Hand freed memory back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def returning(run: Callable) -> Callable:
    """A mapInArrow function that hands memory back when its task ends."""
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    d = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def ragged(lens: np.ndarray) -> np.ndarray:
    """0..len-1 for each length, end to end."""
    lens = np.asarray(lens, np.int64)
    if not len(lens):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(ends[-1]) - np.repeat(ends - lens, lens)


def binary_array(buf: np.ndarray, offs: np.ndarray) -> pa.Array:
    """An Arrow binary array from bytes and offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)),
                                                                     pa.py_buffer(np.ascontiguousarray(buf))]).cast(pa.binary())


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value of each window of ``width`` (by the upper 40
    bits; the leftmost of equals)."""
    step = 1 << 23
    if len(values) > step + width:  # places must fit 24 bits
        return np.concatenate([leftmost_min(values[a:a + step + width - 1], width) + a for a in range(0, len(values) - width + 1, step)])
    low = U64((1 << 24) - 1)
    m = (values & ~low) | np.arange(len(values), dtype=U64)
    span = 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:span - width], m[width - span:])
    return (m & low).astype(np.int64)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [start, start + width) of any start."""
    mark = np.zeros(n + 1, np.int32)
    mark[:-1][starts] = 1
    total = np.cumsum(mark[:-1], dtype=np.int32)
    out = total.copy()
    out[width:] -= total[:-width] if n > width else total[:0]
    return out > 0


def span_lists(flags: np.ndarray, offs: np.ndarray) -> pa.Array:
    """For each row, its maximal runs of True as (start, end) within the row."""
    n = len(offs) - 1
    at = np.arange(len(flags)) + np.repeat(np.arange(n), np.diff(offs)) if len(flags) else np.zeros(0, np.int64)
    fence = np.zeros(len(flags) + n, bool)  # a gap after each row ends its runs
    fence[at] = flags
    s, e = runs(fence)
    row = np.searchsorted(offs[1:] + np.arange(n), s, "right") if len(s) else np.zeros(0, np.int64)
    s, e = s - row - offs[row], e - row - offs[row]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(s), pa.array(e)], ["start", "end"]))
