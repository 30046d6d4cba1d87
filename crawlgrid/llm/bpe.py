"""Byte-level BPE encoding and decoding by a public rank file.

Each match of the split pattern is encoded by itself: distinct pieces of a
batch are laid out in padded numpy matrices, one for each class of lengths,
and in every round each row merges its leftmost pair of least rank. Ranks of
pairs come from an open-addressing hash table; rows that have no pair left
leave the matrix. Pieces longer than ``MATRIX_BYTES`` (where rounds would cost
the square of the length) take the same merges in the same order from a heap.

Null and empty texts give no ids. Rows keep their multiplicity; other columns
are carried only when named in ``carry``. The vocabulary is read on the
executors from ``ranks_path``.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textbuf import ragged, returning

MATRIX_BYTES = 128
CACHE_PIECES = 300_000
LONG_TEXT = 1 << 20
NO_RANK = np.iinfo(np.int32).max


class PairTable:
    """(left id, right id) -> id of the joined token, by linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several for one slot, the last stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined tokens; NO_RANK where a pair has none (or an id is -1)."""
        shape = left.shape
        keys = (left.astype(np.int64) << 20 | right).ravel()
        ask = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        out = np.full(len(keys), NO_RANK, np.int32)
        slot = self._slot(keys[ask])
        while len(ask):
            there = self.keys[slot]
            hit = there == keys[ask]
            out[ask[hit]] = self.values[slot[hit]]
            go = ~hit & (there != -1)
            ask, slot = ask[go], (slot[go] + 1) & self.mask
        return out.reshape(shape)


class Index(dict):
    """Piece -> number, given out at first sight; ``fresh`` has the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]] << 20 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        table = np.array(pairs, np.int64).reshape(-1, 2)
        self.pairs = PairTable(table[:, 0], table[:, 1].astype(np.int32))
        by_id = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            by_id[r] = t
        self.sizes = np.array([len(t) for t in by_id], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.forget()

    # -- encoding ---------------------------------------------------------
    def _matrix(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each piece) of one length class, one merge a row and round."""
        lens = np.array([len(p) for p in raw])
        width = int(lens.max())
        ids = np.full((len(raw), width + 1), -1, np.int32)  # the last column stays empty
        ids[np.repeat(np.arange(len(raw)), lens), ragged(lens)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        result = np.full((len(raw), width), -1, np.int32)
        who, cols = np.arange(len(raw)), np.arange(width + 1)
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(who):
            at = ranks.argmin(1)  # the leftmost of equal ranks
            best = ranks[np.arange(len(who)), at]
            live = best != NO_RANK
            if not live.all():
                result[who[~live], :ids.shape[1] - 1] = ids[~live, :-1]
                who, ids, ranks, at, best = who[live], ids[live], ranks[live], at[live], best[live]
                if not len(who):
                    break
            r = np.arange(len(who))
            ids[r, at] = best
            w = ids.shape[1] - 1  # every live row has lost one id: the matrix narrows by a column
            keep = cols[:w] + (cols[:w] > at[:, None])
            ids = np.take_along_axis(ids, keep, 1)
            ids[:, -1] = np.where(at == w - 1, -1, ids[:, -1])
            ids = np.concatenate((ids, np.full((len(r), 1), -1, np.int32)), 1) if w < 2 else ids
            ranks = np.take_along_axis(ranks, np.minimum(keep[:, :ids.shape[1] - 1], ranks.shape[1] - 1), 1)
            inner = at < ids.shape[1] - 1
            ranks[r[inner], at[inner]] = self.pairs.find(ids[r[inner], at[inner]], ids[r[inner], at[inner] + 1])
            left = (at > 0) & (at - 1 < ids.shape[1] - 1)
            ranks[r[left], at[left] - 1] = self.pairs.find(ids[r[left], at[left] - 1], ids[r[left], at[left]])
        return result[result >= 0], (result >= 0).sum(1)

    def _long(self, piece: bytes) -> np.ndarray:
        """One long piece by a heap of (rank, place); same merges, same order."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        first = self.pairs.find(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        parts = [bytes([b]) for b in piece]
        heap = [(r, i, i + 1) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        there = [True] * n  # False: merged away
        while heap:
            r, i, j = heapq.heappop(heap)
            if not there[i] or nxt[i] != j or self.ranks.get(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            ids[i], there[j] = r, False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b < n and (rank := self.ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (rank, a, b))
        return np.array([x for x, s in zip(ids, there) if s], np.int32)

    def _learn(self) -> None:
        """Ids of the pieces met since the last call go to the pool."""
        fresh, self.index.fresh = self.index.fresh, []
        raws = [p.encode() for p in fresh]
        size = np.zeros(len(raws), np.int64)
        parts: list[np.ndarray] = []
        order: list[np.ndarray] = []
        classes: dict[int, list[int]] = {}
        for k, raw in enumerate(raws):
            if (r := self.ranks.get(raw)) is not None:
                classes.setdefault(-1, []).append(k)
                size[k] = r
            elif len(raw) > MATRIX_BYTES:
                parts.append(self._long(raw))
                order.append(np.array([k]))
                size[k] = len(parts[-1])
            else:
                classes.setdefault((len(raw) - 1).bit_length(), []).append(k)
        if whole := classes.pop(-1, None):
            at = np.array(whole)
            parts.append(size[at].astype(np.int32))
            order.append(at)
            size[at] = 1
        for same in classes.values():
            for i in range(0, len(same), 1 << 13):
                at = np.array(same[i:i + (1 << 13)])
                flat, size[at] = self._matrix([raws[k] for k in at])
                parts.append(flat)
                order.append(at)
        if not parts:
            return
        at = np.concatenate(order)
        begin = np.empty(len(raws), np.int64)
        begin[at] = self.used + np.cumsum(size[at]) - size[at]
        flat = np.concatenate(parts)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[:self.used], np.empty(len(flat) + self.used, np.int32)))
        self.pool[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        n = len(self.index) - len(raws)
        if n + len(raws) > len(self.begin):
            for name in ("begin", "size"):
                setattr(self, name, np.concatenate((getattr(self, name)[:n], np.zeros(n + len(raws), np.int64))))
        self.begin[n:n + len(raws)], self.size[n:n + len(raws)] = begin, size

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) < LONG_TEXT:
            yield self.split.findall(text)
        else:
            found = (m.group() for m in self.split.finditer(text))
            while part := list(islice(found, 100_000)):
                yield part

    def forget(self) -> None:
        """Drop the pieces met so far, so that an idle worker doesn't hold them."""
        self.index, self.used = Index(), 0
        self.pool, self.begin, self.size = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids of each text)."""
        if len(self.index) > CACHE_PIECES:
            self.forget()
        at, count = [], np.zeros(len(texts), np.int64)
        rows, get = [], self.index.__getitem__
        for k, text in enumerate(texts):
            for part in self._pieces(text) if text else ():
                at.append(np.fromiter(map(get, part), np.int64, len(part)))
                rows.append(k)
        self._learn()
        if not at:
            return np.zeros(0, np.int32), count
        np.add.at(count, rows, [int(self.size[x].sum()) for x in at])
        which = np.concatenate(at)
        size = self.size[which]
        return self.pool[np.repeat(self.begin[which], size) + ragged(size)], count

    # -- decoding ---------------------------------------------------------
    def decode(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        return self.blob[np.repeat(self.begins[ids], size) + ragged(size)]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """The codec of this worker process; read once."""
    if (ranks_path, pattern) not in _codecs:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _codecs[ranks_path, pattern] = Codec(ranks, pattern)
    return _codecs[ranks_path, pattern]


def _groups(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        yield i, j
        i = j


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
           out_col: str = "token_ids", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``out_col`` (array of int), a row for each row."""
    df = df.select(*carry, text_col)
    schema = T.StructType([*df.schema.fields[:-1], T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for i, j in _groups(texts, LONG_TEXT):
                flat, count = tool.encode(texts.slice(i, j - i).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns[:-1]] + [ids], names=[*carry, out_col])
        tool.forget()

    return df.mapInArrow(returning(run), schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids",
           out_col: str = "decoded", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``out_col`` (binary); null ids give no bytes."""
    df = df.select(*carry, ids_col)
    keep = [f for f in df.schema.fields[:-1]]
    schema = T.StructType([*keep, T.StructField(out_col, T.BinaryType(), False)])
    if ids_col in carry:
        raise ValueError("ids_col is read anyway; carry it under another name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(ranks_path, pattern)
        for batch in batches:
            rows = batch.column(batch.num_columns - 1)
            for i in range(0, len(rows), 256):
                part = rows.slice(i, 256)
                raw = [tool.decode(np.asarray(x.values, np.int64)).tobytes() if x.is_valid else b"" for x in part]
                yield pa.RecordBatch.from_arrays([c.slice(i, 256) for c in batch.columns[:-1]] + [pa.array(raw, pa.binary())], names=[*carry, out_col])

    return df.mapInArrow(returning(run), schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, token_ids (array of int) and decoded (binary, the ids'
    bytes): encode and decode in one worker."""
    df = df.select(*carry, text_col)
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False),
                           T.StructField("decoded", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for i, j in _groups(texts, LONG_TEXT):
                flat, count = tool.encode(texts.slice(i, j - i).to_pylist())
                cut = np.concatenate(([0], np.cumsum(count)))
                ids = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat))
                raw = [tool.decode(flat[s:e].astype(np.int64)).tobytes() for s, e in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns[:-1]] + [ids, pa.array(raw, pa.binary())], names=schema.names)
        tool.forget()

    return df.mapInArrow(returning(run), schema)
