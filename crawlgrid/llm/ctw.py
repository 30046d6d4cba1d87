"""Language-model scoring by context-tree weighting.

A text is read as lower-cased bytes with an end mark; each byte is eight
binary decisions. A node of the tree is a context (the last d bytes, d = 0 to
``DEPTH``) and the decisions already made in the byte. It counts zeros and
ones, estimates by Krichevsky-Trofimov, and weighs its own estimate (half)
against that of its deeper contexts (half), bottom-up over all training bytes.
The posterior of these weights, taken along the path of the observed contexts,
mixes the estimates of all depths into one probability for each decision. A
context that training never saw has no node: the mixture ends above it.

Spark spreads the work in rounds (see exchange.py): each bucket of documents
sends its distinct byte strings of depth + 1 with their training counts to the
partition of their last two context bytes, where the whole subtree of those
contexts lies; the subtrees' tops (256 contexts of one byte at most) are
joined to the root; then each partition answers the log probability of every
string it was sent, so no part of the model is broadcast or gathered in one
place, and the model may grow with the corpus. Word counts for the base score
travel the same way.

Null texts count as empty (they hold the end alone). Rows with a null id count
as held out (the checksum of an empty text is 0). Repeated rows are learned as
often as they occur. Without training rows each decision has probability 1/2.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .textbuf import LOWER, SLICE_BYTES, SPACED, buffer_of, hashed_words, mix64, slices

DEPTH = 5
END = 0xFF  # no UTF-8 text has this byte: end of text, and what lies before its start
END_TOKEN = np.uint64(0x5851F42D4C957F2D)
ADD = 0.1
CODEC = "zstd"
HALF = np.log(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0 (Stirling's series from x + 7)."""
    shift = np.zeros_like(x)
    for k in range(7):
        shift += np.log(x + k)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def next_one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1.0)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums of the values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec(CODEC, 1).compress(raw, asbytes=True)


def unpack(data: bytes) -> bytes:
    return pa.Codec(CODEC).decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


# -- one bucket of documents -------------------------------------------------
def strings(low: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The byte string (context and next byte) of each byte and end, row by row."""
    n, rows = len(offs) - 1, np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    padded = np.full(len(low) + n * (DEPTH + 1) + 8, END, np.uint8)
    padded[np.arange(len(low)) + (rows + 1) * DEPTH + rows] = low
    g = np.zeros(len(padded) - 8 - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        g = g << np.uint64(8) | padded[k:k + len(g)]
    own = np.ones(len(padded) - 8, bool)  # all but the marks before each row
    starts = offs[:-1] + np.arange(n) * (DEPTH + 1)
    for k in range(DEPTH):
        own[starts + k] = False
    return g[own[DEPTH:]]


def string_pieces(low: np.ndarray, offs: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, byte string) of each byte and end; one long text in pieces of
    ``size`` bytes, each read with the context before it."""
    if len(offs) > 2 or len(low) <= size:
        yield np.repeat(np.arange(len(offs) - 1), np.diff(offs) + 1), strings(low, offs)
        return
    for a in range(0, len(low), size):
        b, before = min(a + size, len(low)), min(a, DEPTH)
        got = strings(low[a - before:b], np.array([0, b - a + before]))[before:]
        got = got if b == len(low) else got[:-1]
        yield np.zeros(len(got), np.int64), got


class Shelf:
    """Distinct words and byte strings of a bucket with their training counts;
    with ``keep`` also where in the texts they stand, slice by slice."""

    def __init__(self, table: pa.Table, parts: int, keep: bool = False):
        self.buf, self.offs = buffer_of(table.column("text"))
        held = pc.struct_field(table.column("r").combine_chunks(), "held_out")
        self.train = ~np.asarray(held.fill_null(True).to_numpy(zero_copy_only=False), bool)
        got: list[list[np.ndarray]] = [[], [], [], []]
        self.kept: list[tuple[np.ndarray, ...]] = []
        for low, offs, rows, hashes, train in self.slices():
            words_, w = np.unique(hashes, return_inverse=True)
            got[0].append(words_)
            got[1].append(np.bincount(w, train[rows], len(words_)).astype(np.int64))
            pieces = []
            for mark, g in string_pieces(low, offs, SLICE_BYTES // 2):
                grams, g = np.unique(g, return_inverse=True)
                got[2].append(grams)
                got[3].append(np.bincount(g, train[mark], len(grams)).astype(np.int64))
                if keep:
                    pieces.append((mark.astype(np.int32), grams, g.astype(np.int32)))
            if keep:
                self.kept.append((offs, rows, words_, w.astype(np.int32), pieces))
        z = np.zeros(0, np.int64)
        def whole(kind: type) -> np.ndarray:
            slices_ = got.pop(0)  # each list goes before the next one is joined
            return np.concatenate(slices_).astype(kind, copy=False) if slices_ else z.astype(kind)

        self.words, self.word_counts = summed(whole(np.uint64), whole(np.int64))
        self.grams, self.gram_counts = summed(whole(np.uint64), whole(np.int64))
        part = X.part_of(mix64(self.grams >> np.uint64(8) & np.uint64(0xFFFF)), parts)
        self.order = np.argsort(part, kind="stable")  # ascending strings in each partition
        self.gram_cut = np.searchsorted(part[self.order], np.arange(parts + 1))
        self.word_cut = np.searchsorted(X.part_of(self.words, parts), np.arange(parts + 1))

    def slices(self) -> Iterator[tuple[np.ndarray, ...]]:
        for i, j in slices(self.offs):
            low, offs = LOWER[self.buf[self.offs[i]:self.offs[j]]], self.offs[i:j + 1] - self.offs[i]
            _, _, rows, hashes = hashed_words(low, offs, SPACED)
            hashes = np.append(hashes, np.full(j - i, END_TOKEN, hashes.dtype))
            yield low, offs, np.append(rows, np.arange(j - i)), hashes, self.train[i:j]


def send(b: int, table: pa.Table, parts: int) -> list:
    got, out = Shelf(table, parts), []
    for p in range(parts):
        s, e = got.word_cut[p:p + 2]
        if e > s:
            out.append((b, p, 1, pack(np.int64([e - s]), steps(got.words[s:e]), got.word_counts[s:e])))
        at = got.order[got.gram_cut[p]:got.gram_cut[p + 1]]
        if len(at):
            out.append((b, p, 2, pack(np.int64([len(at)]), steps(got.grams[at]), got.gram_counts[at])))
    return out


def received(table: pa.Table, kind: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """(bucket, keys, counts) of each blob of one kind."""
    bs, keys, counts = [], [], []
    for b, k, data in zip(table.column("b").to_pylist(), table.column("kind").to_pylist(), table.column("data")):
        if k == kind:
            raw = unpack(data.as_py())
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            bs.append(b)
            keys.append(np.cumsum(np.frombuffer(raw, np.uint64, n, 8), dtype=np.uint64))
            counts.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
    return bs, keys, counts


# -- the tree ----------------------------------------------------------------
class Subtree:
    """Nodes of depth 2 to DEPTH under the contexts of one partition. A node's
    key is its context and, in the lowest byte, 1 before the decisions made."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        seen = counts > 0
        grams, counts = grams[seen], counts[seen]
        context, byte = grams >> np.uint64(8), grams & np.uint64(255)
        keys, zeros, ones = [], [], []
        for k in range(8):
            prefix = np.uint64(1 << k) | byte >> np.uint64(8 - k)
            bit = (byte >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
            keys.append(context << np.uint64(8) | prefix)
            zeros.append(counts * (1 - bit))
            ones.append(counts * bit)
        key, n0, n1 = summed(*(np.concatenate(x) for x in (keys, zeros, ones)))
        pe = block(n0.astype(float), n1.astype(float))
        self.levels = {DEPTH: (key, n0, n1, pe, pe)}
        for d in range(DEPTH - 1, 1, -1):
            key, n0, n1, kids = summed(shorter(key, d), n0, n1, self.levels[d + 1][4])
            pe = block(n0.astype(float), n1.astype(float))
            self.levels[d] = (key, n0, n1, pe, np.logaddexp(HALF + pe, HALF + kids))

    def tops(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each context of one byte: zeros, ones and the children's weighted logs."""
        key, n0, n1, _, pw = self.levels[2]
        own, n0, n1, kids = summed(shorter(key, 1), n0, n1, pw)
        byte = (own >> np.uint64(8)).astype(np.int64)
        for c in np.unique(byte):
            out, at = np.zeros((3, 256)), byte == c
            out[:, (own[at] & np.uint64(255)).astype(np.int64)] = n0[at], n1[at], kids[at]
            yield int(c), out

    def mixtures(self, above: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Depth -> (keys, probability of a one when the path ends there);
        ``above`` has, for context byte and node, what depths 0 and 1 give."""
        out, before = {}, None
        for d in range(2, DEPTH + 1):
            key, n0, n1, pe, pw = self.levels[d]
            if d == 2:
                c, b = (key >> np.uint64(8) & np.uint64(255)).astype(np.int64), (key & np.uint64(255)).astype(np.int64)
                done, rest = above[c, 0, b], above[c, 1, b]
            else:
                at = np.searchsorted(before[0], shorter(key, d - 1))
                done, rest = before[1][at], before[2][at]
            one = next_one(n0, n1)
            out[d] = (key, done + rest * one)
            stop = np.exp(HALF + pe - pw) if d < DEPTH else np.ones(len(key))
            before = (key, done + rest * stop * one, rest * (1 - stop))
        return out


def shorter(key: np.ndarray, depth: int) -> np.ndarray:
    """The key of the same node in the context of its last ``depth`` bytes."""
    return key & np.uint64((1 << 8 * (depth + 1)) - 1)


def log_probabilities(grams: np.ndarray, counts: np.ndarray, above: np.ndarray) -> np.ndarray:
    """log10 of the probability of each string's last byte in its context."""
    mixed = Subtree(grams, counts).mixtures(above)
    context, byte = grams >> np.uint64(8), grams & np.uint64(255)
    total = np.zeros(len(grams))
    for k in range(8):
        prefix = np.uint64(1 << k) | byte >> np.uint64(8 - k)
        one = above[(context & np.uint64(255)).astype(np.int64), 2, prefix.astype(np.int64)]
        todo = np.arange(len(grams))
        for d in range(DEPTH, 1, -1):
            key, p = mixed[d]
            if not len(key):
                continue
            ask = shorter(context[todo] << np.uint64(8) | prefix[todo], d)
            at = np.minimum(np.searchsorted(key, ask), len(key) - 1)
            hit = key[at] == ask
            one[todo[hit]] = p[at[hit]]
            todo = todo[~hit]
        bit = byte >> np.uint64(7 - k) & np.uint64(1)
        total += np.log10(np.where(bit == 1, one, 1 - one))
    return total


TOP = "part int, kind int, c int, data binary, train_tokens long, distinct long"


def tops(table: pa.Table) -> pa.Table:
    """Of one key partition: word totals, and the tops of its subtrees."""
    part = table.column("part")[0].as_py()
    _, keys, counts = received(table, 1)
    n = v = 0
    if keys:
        _, total = summed(np.concatenate(keys), np.concatenate(counts))
        n, v = int(total.sum()), int((total > 0).sum())
    rows = [(part, 0, -1, b"", n, v)]
    _, keys, counts = received(table, 2)
    if keys:
        grams, total = summed(np.concatenate(keys), np.concatenate(counts))
        found = dict(Subtree(grams, total).tops())
        for c in np.unique(grams >> np.uint64(8) & np.uint64(255)).tolist():  # those only held-out rows have, too
            rows.append((part, 1, c, found.get(c, np.zeros((3, 256))).tobytes(), 0, 0))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["part", "kind", "c", "data", "train_tokens", "distinct"])


def one_byte(table: pa.Table) -> pa.Table:
    """The sum of one context byte's tops over the partitions."""
    total = sum(np.frombuffer(x.as_py()).reshape(3, 256) for x in table.column("data"))
    return pa.table({"c": pa.array([table.column("c")[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def root(table: pa.Table) -> pa.Table:
    """From the contexts of one byte (256 rows at most): for each, what depths 0
    and 1 contribute below, the weight left there, and the mixture ending there."""
    cs = table.column("c").to_pylist()
    tops = np.stack([np.frombuffer(x.as_py()).reshape(3, 256) for x in table.column("data")])
    n0, n1, kids = tops[:, 0], tops[:, 1], tops[:, 2]
    pe, seen = block(n0, n1), n0 + n1 > 0
    pw = np.where(seen, np.logaddexp(HALF + pe, HALF + kids), 0)
    r0, r1 = n0.sum(0), n1.sum(0)
    pe_root = block(r0, r1)
    stop_root = np.exp(HALF + pe_root - np.logaddexp(HALF + pe_root, HALF + pw.sum(0)))
    done = stop_root * next_one(r0, r1)
    rest = 1 - stop_root
    one, stop = next_one(n0, n1), np.where(seen, np.exp(HALF + pe - pw), 1)
    end = np.where(seen, done + rest * one, next_one(r0, r1))
    out = np.stack((done + rest * stop * one, rest * (1 - stop), end), 1)
    return pa.table({"c": pa.array(cs, pa.int32()), "data": pa.array([x.tobytes() for x in out], pa.binary())})


def reply(left: pa.Table, right: pa.Table) -> pa.Table:
    """To each bucket: training counts of its words, log probabilities of its strings."""
    if not left.num_rows:
        return X.blobs([])
    part, rows = left.column("part")[0].as_py(), []
    above = np.full((256, 3, 256), 0.5)
    n = v = 0
    for c, data, t, d in zip(*(right.column(x).to_pylist() for x in ("c", "data", "train_tokens", "distinct"))):
        if c >= 0:
            above[c] = np.frombuffer(data).reshape(3, 256)
        else:
            n, v = t, d
    bs, keys, counts = received(left, 1)
    if keys:
        known, total = summed(np.concatenate(keys), np.concatenate(counts))
        rows += [(b, part, 1, pack(np.int64([n, v]), total[np.searchsorted(known, k)])) for b, k in zip(bs, keys)]
    bs, keys, counts = received(left, 2)
    if keys:
        grams, total = summed(np.concatenate(keys), np.concatenate(counts))
        log = log_probabilities(grams, total, above)
        rows += [(b, part, 2, pack(log[np.searchsorted(grams, k)])) for b, k in zip(bs, keys)]
    return X.blobs(rows)


def scores(table: pa.Table, answer: pa.Table, parts: int) -> list:
    got = Shelf(table, parts, keep=True)
    total, log = np.empty(len(got.words), np.int64), np.empty(len(got.grams))
    n = v = 0
    for p, data in X.answers(answer, 1):
        raw = unpack(data)
        n, v = np.frombuffer(raw, np.int64, 2).tolist()
        total[got.word_cut[p]:got.word_cut[p + 1]] = np.frombuffer(raw, np.int64, offset=16)
    for p, data in X.answers(answer, 2):
        log[got.order[got.gram_cut[p]:got.gram_cut[p + 1]]] = np.frombuffer(unpack(data), np.float64)
    cols: list[list[np.ndarray]] = [[], [], [], [], []]
    for offs, rows, words_, w, pieces in got.kept:
        m = len(offs) - 1
        c = total[np.searchsorted(got.words, words_)][w]
        count = np.bincount(rows, minlength=m)
        logs = sum(np.bincount(mark, log[np.searchsorted(got.grams, grams)][g], m) for mark, grams, g in pieces)
        parts_ = (count, np.bincount(rows, c > 0, m), np.bincount(rows, np.log10(c + ADD), m) - count * np.log10(n + ADD * (v + 1)),
                  logs, np.diff(offs))
        for col, x in zip(cols, parts_):
            col.append(x)
    n_tokens, known, base, score, size = (np.concatenate(x) for x in cols)
    return [n_tokens.astype(np.int64), known.astype(np.int64), np.full(len(size), n, np.int64), base, score, -score * np.log2(10) / np.maximum(size, 1)]


def score(docs: DataFrame, hold_out: int = 10, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(id, carry..., held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte); rows whose crc32(id as text) mod ``hold_out`` is 0
    are not learned from. ``score`` is log10 of the text's probability."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % hold_out == 0
    docs = docs.select(id_col, text_col, *carry).withColumn("held_out", held)
    spread, parts = X.bucketed(docs, id_col, text_col, (*carry, "held_out"))
    sent = X.to_parts(spread, lambda b, t: send(b, t, parts))
    top = sent.groupBy("part").applyInArrow(tops, TOP)
    pairs = top.where("kind = 1").select("part", "c", "data")
    one = pairs.groupBy("c").applyInArrow(one_byte, "c int, data binary")
    tree = one.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(root, "c int, data binary")  # 256 rows at most
    none = F.lit(0).cast("long")
    below = pairs.select("part", "c").join(tree, "c").select("part", "c", "data", none.alias("train_tokens"), none.alias("distinct"))
    words_ = top.where("kind = 0")
    stats = words_.groupBy().agg(F.sum("train_tokens").alias("train_tokens"), F.sum("distinct").alias("distinct"), F.lit(-1).alias("c"))
    each = words_.select("part", "c", "data").join(F.broadcast(stats), "c")  # one row
    right = below.unionByName(each.select("part", "c", "data", "train_tokens", "distinct"))
    back = sent.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(reply, X.BLOB)
    return X.finish(spread, back, lambda t, a: scores(t, a, parts),
                    "n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
