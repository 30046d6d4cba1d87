"""Substring dedup of words by level-wise doubling.

Removes each word covered by a window of ``n`` words whose word sequence also
starts in a document with a smaller id. Words are runs without white space,
unchanged; windows are judged on the input.

Levels of length 4, 8, 16, ... (the last capped at n): a window of n words
can only repeat if the shorter windows in it do, so a level looks at one
shorter window of each candidate, the least-hashed one inside it (equal
candidates choose the same). Windows that several documents have at one length
are alone extended to twice that length, until n, or until none survives. Each
round sends a bucket's distinct window hashes once. The last level sends 96
bits of hash for each surviving window with the bucket's least document, and
gets back one bit: whether another bucket has a smaller one.

Null texts have no words. A null id is larger than any other. Rows of the same
id don't remove from each other; repeated rows have the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from .textbuf import SPACED, binary_array, buffer_of, covered, hashed_words, leftmost_min, mix64, prefix, ragged, slices, span_lists, window_hash

WINDOW_WORDS = 13
FIRST_LEVEL = 4


def levels(n: int) -> list[int]:
    """Lengths below n at which windows are tested."""
    out, k = [], min(FIRST_LEVEL, n)
    while k < n:
        out.append(k)
        k *= 2
    return out


class Shard:
    """Words of a slice of rows, and its windows of n words."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, ids: np.ndarray, n: int):
        self.buf, self.offs, self.n = buf, offs, n
        self.starts, self.ends, self.rows, hashes = hashed_words(buf, offs, SPACED)
        self.count = np.bincount(self.rows, minlength=len(offs) - 1)
        self.stop = np.cumsum(self.count)
        self.windows = np.flatnonzero(np.arange(len(self.rows)) + n <= self.stop[self.rows]) if len(self.rows) else np.zeros(0, np.int64)
        self.owner = ids[self.rows[self.windows]] if len(self.windows) else self.windows
        self.pre = prefix(hashes) if len(self.windows) else None

    def least(self, length: int, at: np.ndarray) -> np.ndarray:
        """Hash of the least-hashed window of ``length`` words inside each window at ``at``."""
        grams = np.arange(len(self.rows) - length + 1)
        h = window_hash(self.pre, grams, grams + length)
        # least hashes are small: mixed again, so that key partitions are even
        return mix64(h[leftmost_min(h, self.n - length + 1)[at]])

    def exact(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each window's words."""
        second = prefix(hashed_words(self.buf, self.offs, SPACED, 1)[3], 1)
        return window_hash(self.pre, at, at + self.n), (window_hash(second, at, at + self.n, 1) >> np.uint64(32)).astype(np.uint32)


def shards(table: pa.Table, n: int) -> Iterator[Shard]:
    buf, offs = buffer_of(table.column("text"))
    ids = X.ids_of(table)
    for i, j in slices(offs):
        yield Shard(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], ids[i:j], n)


def survivors(shard: Shard, level: int | None, known: np.ndarray) -> np.ndarray:
    """Which windows passed the given level (all, before the first)."""
    if not len(shard.windows):
        return np.zeros(0, bool)
    return np.ones(len(shard.windows), bool) if level is None else X.member(shard.least(level, shard.windows), known)


def level_keys(b: int, table: pa.Table, answer: pa.Table | None, n: int, parts: int, level: int, before: int | None) -> list:
    """Distinct windows of this level inside what survived the level before."""
    known = X.known_keys(answer, before) if answer is not None else None
    keys, ids = [], []
    for shard in shards(table, n):
        on = survivors(shard, before, known)
        if on.any():
            k = shard.least(level, shard.windows[on])
            ids_on = shard.owner[on]
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (ids_on[1:] != ids_on[:-1])))
            keys.append(k[new])
            ids.append(ids_on[new])
    if not keys:
        return []
    return X.key_blobs(b, level, *X.distinct_keys(np.concatenate(keys), np.concatenate(ids)), parts)


class Finalists:
    """The distinct windows of a bucket that survived all levels, in order of hash."""

    def __init__(self, table: pa.Table, answer: pa.Table, n: int):
        steps = levels(n)
        last = steps[-1] if steps else None
        known = X.known_keys(answer, last) if last else None
        self.shards, places, h1, h2, owner = [], [], [], [], []
        for k, shard in enumerate(shards(table, n)):
            self.shards.append(shard)
            at = shard.windows[survivors(shard, last, known)]
            if len(at):
                a, b = shard.exact(at)
                h1.append(a)
                h2.append(b)
                owner.append(shard.owner[np.searchsorted(shard.windows, at)])
                places.append((k, at))
            shard.pre = None
        self.places = places
        z = np.zeros(0, np.int64)
        h1, h2, owner = (np.concatenate(x) if x else z.astype(t) for x, t in ((h1, np.uint64), (h2, np.uint32), (owner, np.int64)))
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        self.h1, self.h2 = a[first], b[first]
        self.least = np.minimum.reduceat(owner[order], first) if len(first) else z
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.owner = owner


def final_keys(b: int, table: pa.Table, answer: pa.Table, n: int, parts: int) -> list:
    got = Finalists(table, answer, n)
    cut = np.searchsorted(X.part_of(got.h1, parts), np.arange(parts + 1))
    return [(b, p, n, np.int64(e - s).tobytes() + got.h1[s:e].tobytes() + got.h2[s:e].tobytes() + got.least[s:e].tobytes())
            for p, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s]


def smaller_elsewhere(table: pa.Table) -> pa.Table:
    """Of one key partition: one bit for each entry, whether another has a smaller document."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    bs, h1, h2, least = table.column("b").to_pylist(), [], [], []
    for x in table.column("data"):
        data = x.as_py()
        m = int(np.frombuffer(data, np.int64, 1)[0])
        h1.append(np.frombuffer(data, np.uint64, m, 8))
        h2.append(np.frombuffer(data, np.uint32, m, 8 + 8 * m))
        least.append(np.frombuffer(data, np.int64, m, 8 + 12 * m))
    cut = np.concatenate(([0], np.cumsum([len(x) for x in h1])))
    h1, h2, least = np.concatenate(h1), np.concatenate(h2), np.concatenate(least)
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    low = np.minimum.reduceat(least[order], first)
    flag = np.empty(len(order), bool)
    flag[order] = np.repeat(low, np.diff(np.append(first, len(order)))) < least[order]
    return X.blobs([(b, part, kind, np.packbits(flag[s:e]).tobytes()) for b, s, e in zip(bs, cut[:-1], cut[1:])])


def kept(table: pa.Table, answer: pa.Table, n: int, parts: int) -> list:
    got = Finalists(table, answer, n)
    if len(got.h1):
        bits = dict(X.answers(answer, n))
        cut = np.searchsorted(X.part_of(got.h1, parts), np.arange(parts + 1))
        flag = np.concatenate([np.unpackbits(np.frombuffer(bits[p], np.uint8), count=e - s) for p, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s]).astype(bool)
        removed = flag[got.entry] | (got.owner > got.least[got.entry])
    begin, at = 0, {}
    for k, places in got.places:
        at[k] = places[removed[begin:begin + len(places)]]
        begin += len(places)
    counts, raws, sizes, spans = [], [], [], []
    for k, shard in enumerate(got.shards):
        gone = covered(at.get(k, np.zeros(0, np.int64)), n, len(shard.rows))
        keep = ~gone
        lens = shard.ends[keep] - shard.starts[keep]
        # each kept word with one blank after it; the last of a row goes without
        joined = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
        word_end = np.cumsum(lens + 1)
        joined[np.repeat(word_end - lens - 1, lens) + ragged(lens)] = shard.buf[np.repeat(shard.starts[keep], lens) + ragged(lens)]
        rows = shard.rows[keep]
        last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) if len(rows) else np.zeros(0, np.int64)
        trim = np.ones(len(joined), bool)
        trim[word_end[last] - 1] = False
        raws.append(joined[trim])
        size = np.bincount(rows, lens + 1, len(shard.count)).astype(np.int64)
        sizes.append(size - (size > 0))
        counts.append(shard.count)
        spans.append(span_lists(gone, np.concatenate(([0], shard.stop))))
    offs = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    return [pa.array(np.concatenate(counts).astype(np.int64)), binary_array(np.concatenate(raws), offs).cast(pa.string()), pa.chunked_array(spans)]


def dedup(docs: DataFrame, n: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(id, carry..., n_words, kept, spans) for each row: the words that stay,
    joined by one blank, and the maximal removed runs of words."""
    # keys are short and come in several rounds: fewer, fuller packed rows
    spread, parts = X.bucketed(docs, id_col, text_col, carry)
    parts = max(1, parts // 2)
    answer, before = None, None
    for level in levels(n):
        if answer is None:
            sent = X.to_parts(spread, lambda b, t, k=level: level_keys(b, t, None, n, parts, k, None))
        else:
            sent = X.to_parts(spread, lambda b, t, a, k=level, p=before: level_keys(b, t, a, n, parts, k, p), answer)
        answer, before = X.to_buckets(sent, X.shared_keys), level
    none = answer if answer is not None else docs.sparkSession.createDataFrame([], X.BLOB)
    bits = X.to_buckets(X.to_parts(spread, lambda b, t, a: final_keys(b, t, a, n, parts), none), smaller_elsewhere)
    return X.finish(spread, none.unionByName(bits), lambda t, a: kept(t, a, n, parts),
                    "n_words long, kept string, spans array<struct<start:long,end:long>>")
