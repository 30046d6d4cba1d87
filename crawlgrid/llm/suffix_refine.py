"""Suffix-array dedup of bytes by bucket-pointer refinement.

Removes each byte that lies in a string of ``n`` bytes which also starts in a
document with a smaller id. Strings are judged on the input.

Every window of n bytes is assigned to its anchor, the least-hashed k-gram in
it, so equal windows always share an anchor. A first round finds the anchors
that several documents have. For those, the fragments around them (all windows
of one anchor, a little over n bytes) go to the anchor's partition, each
distinct one once a bucket. There the suffixes of the fragments are sorted by
bucket-pointer refinement: q-grams give the initial buckets; a bucket is
refined by sorting its suffixes on the bucket pointers at the offset of the
depth reached, and as the updated pointers are used by the later, deeper
refinements, the depth doubles until n. Fragments are compared by their own
bytes; the hashes of anchors merely bring them together, and fragments of
equal hashes are merged if their bytes are equal, too. Each class of equal windows has a least
document; one bit a window goes back to the bucket.

Null texts count as empty. A null id is larger than any other. Rows of the
same id don't remove from each other; repeated rows have the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from .textbuf import BYTE_VALUES, binary_array, buffer_of, covered, leftmost_min, mix64, prefix, ragged, span_lists, window_hash

STRING_BYTES = 50
GRAM = 20
FIRST_GRAM = 8
SLICE = 1 << 18
REFINE = 1 << 18
CODEC = "zstd"


def anchored(buf: np.ndarray, offs: np.ndarray, n: int, whole: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Maximal runs of windows that share an anchor, slice by slice: (first
    start, last start + 1, anchor hash[, hash of the run's bytes])."""
    k = min(GRAM, n)
    for a in range(0, len(buf), SLICE):
        z = min(len(buf), a + SLICE)
        seg = buf[a:min(len(buf), z + n - 1)]
        if len(seg) < n:
            continue
        lo, hi = np.searchsorted(offs, a, "right") - 1, np.searchsorted(offs, z, "left")
        ends = offs[lo + 1:hi + 1]
        size = np.diff(np.concatenate(([a], np.minimum(ends, z))))
        last = np.repeat(ends, size)[:len(seg) - n + 1] - a - n
        at = np.arange(len(last))
        ok = at <= last
        values = BYTE_VALUES[seg]
        grams = np.arange(len(seg) - k + 1)
        h = window_hash(prefix(values), grams, grams + k)
        spot = leftmost_min(h, n - k + 1)[:len(last)]
        new = ok.copy()
        new[1:] &= ~(ok[:-1] & (spot[1:] == spot[:-1]))
        begin = np.flatnonzero(new)
        stop = ok.copy()
        stop[:-1] &= ~(ok[1:] & (spot[1:] == spot[:-1]))
        end = np.flatnonzero(stop) + 1
        # least hashes are small: mixed again, so that key partitions are even
        out = (begin + a, end + a, mix64(h[spot[begin]]))
        if whole:
            out += (window_hash(prefix(values, 1), begin, end + n - 1, 1),)
        yield out


def anchors(b: int, table: pa.Table, n: int, parts: int) -> list:
    buf, offs = buffer_of(table.column("text"))
    ids = X.ids_of(table)
    got = [(h, ids[np.searchsorted(offs, s, "right") - 1]) for s, _, h in anchored(buf, offs, n)]
    if not got:
        return []
    keys, several = X.distinct_keys(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
    return X.key_blobs(b, 1, keys, several, parts)


def _differ(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Of neighbours that are alike (place k and the one before): do their bytes differ?"""
    out = np.zeros(len(starts), bool)
    at = np.flatnonzero(alike)
    for k in range(0, len(at), SLICE >> 6):
        two = at[k:k + (SLICE >> 6)]
        size = lens[two]
        step = ragged(size)
        unequal = buf[np.repeat(starts[two], size) + step] != buf[np.repeat(starts[two - 1], size) + step]
        out[two] = np.add.reduceat(unequal, np.cumsum(size) - size, dtype=np.int64) > 0
    return out


class Fragments:
    """The distinct fragments of a bucket around shared anchors, in a fixed order."""

    def __init__(self, table: pa.Table, known: np.ndarray, n: int):
        self.buf, self.offs = buffer_of(table.column("text"))
        self.ids = X.ids_of(table)
        got = []
        for s, e, h, f in anchored(self.buf, self.offs, n, True):
            on = X.member(h, known)
            got.append((s[on], e[on], h[on], f[on]))
        z = np.zeros(0, np.int64)
        s, e, h, f = (np.concatenate(x) for x in zip(*got)) if got else (z, z, z.astype(np.uint64), z.astype(np.uint64))
        order = np.lexsort((e - s, f, h))
        s, e, h, f = s[order], e[order], h[order], f[order]
        self.starts, self.counts = s, e - s  # windows of each occurrence
        self.owner = self.ids[np.searchsorted(self.offs, s, "right") - 1] if len(s) else z
        new = np.ones(len(s), bool)
        new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1]) | (self.counts[1:] != self.counts[:-1])
        odd = _differ(self.buf, s, self.counts + n - 1, ~new)
        if odd.any():  # equal hashes of unequal bytes: in the order of their bytes, whatever that of the rows
            heads = np.flatnonzero(new)
            for a in np.unique(heads[np.searchsorted(heads, np.flatnonzero(odd), "right") - 1]).tolist():
                z = int(heads[np.searchsorted(heads, a, "right")]) if a < heads[-1] else len(s)
                raw = [self.buf[x:x + self.counts[a] + n - 1].tobytes() for x in s[a:z].tolist()]
                by = sorted(range(z - a), key=raw.__getitem__)
                s[a:z], self.owner[a:z] = s[a:z][by], self.owner[a:z][by]
                new[a + 1:z] = [raw[i] != raw[j] for i, j in zip(by[1:], by)]
        self.entry = np.cumsum(new) - 1  # of each occurrence
        first = np.flatnonzero(new)
        self.first, self.hash, self.marks = first, h[first], f[first]
        self.least = np.minimum.reduceat(self.owner, first) if len(first) else z


def fragments(b: int, table: pa.Table, answer: pa.Table, n: int, parts: int) -> list:
    got = Fragments(table, X.known_keys(answer, 1), n)
    cut = np.searchsorted(X.part_of(got.hash, parts), np.arange(parts + 1))
    out = []
    for p, (s, e) in enumerate(zip(cut[:-1], cut[1:])):
        if e > s:
            at = got.first[s:e]
            lens = got.counts[at] + n - 1
            raw = got.buf[np.repeat(got.starts[at], lens) + ragged(lens)]
            head = np.array([e - s, len(raw)], np.int64)
            packed = pa.Codec(CODEC, 1).compress(raw.tobytes(), asbytes=True)
            out.append((b, p, 2, b"".join((head.tobytes(), got.hash[s:e].tobytes(), got.marks[s:e].tobytes(), got.least[s:e].tobytes(), got.counts[at].astype(np.int32).tobytes(), packed))))
    return out


def unpack(data: bytes) -> tuple[np.ndarray, ...]:
    m, size = np.frombuffer(data, np.int64, 2)
    h, f = np.frombuffer(data, np.uint64, 2 * m, 16).reshape(2, m)
    least = np.frombuffer(data, np.int64, m, 16 + 16 * m)
    counts = np.frombuffer(data, np.int32, m, 16 + 24 * m).astype(np.int64)
    raw = pa.Codec(CODEC).decompress(data[16 + 28 * m:], int(size), asbytes=True)
    return h, f, least, counts, np.frombuffer(raw, np.uint8)


def refine(text: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Bucket pointers of all places of ``text`` (whose fragments end at
    ``ends``, given for each place) to depth n: equal for two places with n
    bytes left exactly if these bytes are equal."""
    depth = min(FIRST_GRAM, n)
    left = ends - np.arange(len(text))
    place = np.flatnonzero(left >= depth)
    code = np.zeros(len(place), np.uint64)
    for k in range(depth):
        code = code << np.uint64(8) | text[place + k].astype(np.uint64)
    pointer = np.zeros(len(text), np.int64)
    order = np.argsort(code, kind="stable")
    active, pointer = _renumber(place[order], code[order], np.zeros(len(order), np.int64), pointer)
    while depth < n:
        offset = min(depth, n - depth)  # the pointers there already reach ``depth``
        active = active[left[active] >= depth + offset]
        own, later = pointer[active], pointer[active + offset]
        order = np.lexsort((later, own))
        active, own, later = active[order], own[order], later[order]
        active, pointer = _renumber(active, later, own, pointer)
        depth += offset
    return pointer


def _renumber(place: np.ndarray, key: np.ndarray, own: np.ndarray, pointer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New pointers of places sorted by (own, key): a bucket's pointer plus the
    rank of the sub-bucket's first member. Places alone in a bucket are done."""
    if not len(place):
        return place, pointer
    new_own = np.concatenate(([True], own[1:] != own[:-1]))
    new = new_own | np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new)
    base = np.flatnonzero(new_own)
    size = np.diff(np.append(first, len(place)))
    pointer[place] = own + np.repeat(first, size) - np.repeat(base, np.diff(np.append(base, len(place))))
    return place[np.repeat(size > 1, size)], pointer


def settle(table: pa.Table, n: int) -> pa.Table:
    """One bit for each window of each fragment sent: whether a document of
    another bucket with a smaller id than the sender's least has it."""
    part, bs = table.column("part")[0].as_py(), table.column("b").to_pylist()
    got = [unpack(x.as_py()) for x in table.column("data")]
    h, f, least, counts = (np.concatenate([g[k] for g in got]) for k in range(4))
    senders = np.cumsum([0] + [len(g[0]) for g in got])
    lens = counts + n - 1
    begin = np.concatenate([np.cumsum(g[3] + n - 1) - (g[3] + n - 1) for g in got])  # within the sender's text
    order = np.lexsort((counts, f, h))  # equal fragments side by side
    new_h = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    new = new_h | np.concatenate(([True], (f[order][1:] != f[order][:-1]) | (counts[order][1:] != counts[order][:-1])))
    whole = np.concatenate([g[4] for g in got])
    at = (begin + np.repeat(np.cumsum([0] + [len(g[4]) for g in got[:-1]]), [len(g[0]) for g in got]))[order]
    new |= _differ(whole, at, lens[order], ~new)
    del whole
    first = np.flatnonzero(new)
    lowest = np.minimum.reduceat(least[order], first)  # of each distinct fragment
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    group = np.cumsum(new_h)[first] - 1  # anchor of each distinct fragment
    sent = order[first]  # who sent it first
    flags = np.repeat(lowest[entry] < least, counts)  # one after the other, as sent
    flag_at = np.cumsum(counts) - counts
    # an anchor of one distinct fragment has nothing to refine; others in pieces
    todo = np.flatnonzero(np.bincount(group)[group] > 1)
    by_group = np.flatnonzero(np.concatenate(([True], group[todo][1:] != group[todo][:-1]))) if len(todo) else todo
    fill = np.concatenate(([0], np.cumsum(lens[sent[todo]])))
    members = np.argsort(entry, kind="stable")
    member_cut = np.searchsorted(entry[members], np.arange(len(first) + 1))
    edges, i = np.append(by_group, len(todo)), 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(fill[edges], fill[edges[i]] + REFINE, "right")) - 1)
        piece = todo[edges[i]:edges[j]]
        src = sent[piece]
        text = np.concatenate([got[k][4][begin[x]:begin[x] + lens[x]] for k, x in zip(np.searchsorted(senders, src, "right") - 1, src)])
        best = _least_documents(text, lens[src], counts[src], lowest[piece], n)
        # to all who sent one of these fragments
        copies = member_cut[piece + 1] - member_cut[piece]
        who = members[np.repeat(member_cut[piece], copies) + ragged(copies)]
        at = np.repeat(np.cumsum(counts[src]) - counts[src], copies)
        size = counts[who]
        flags[np.repeat(flag_at[who], size) + ragged(size)] = best[np.repeat(at, size) + ragged(size)] < np.repeat(least[who], size)
        i = j
    ends = np.append(flag_at, len(flags))[senders]
    return X.blobs([(b, part, 2, np.packbits(flags[s:e]).tobytes()) for b, s, e in zip(bs, ends[:-1], ends[1:])])


def _least_documents(text: np.ndarray, size: np.ndarray, windows: np.ndarray, lowest: np.ndarray, n: int) -> np.ndarray:
    """Least document of each window of some fragments (end to end in ``text``)."""
    stop = np.repeat(np.cumsum(size), size)
    pointer = refine(text, stop, n)
    cls = pointer[stop - np.arange(len(text)) >= n]  # the windows of one fragment after the other
    best = np.repeat(lowest, windows)
    by = np.argsort(cls, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], cls[by][1:] != cls[by][:-1])))
    best[by] = np.repeat(np.minimum.reduceat(best[by], head), np.diff(np.append(head, len(cls))))
    return best


def kept(table: pa.Table, answer: pa.Table, n: int, parts: int, whole_characters: bool) -> list:
    got = Fragments(table, X.known_keys(answer, 1), n)
    gone = np.zeros(len(got.buf), bool)
    if len(got.first):
        bits = dict(X.answers(answer, 2))
        sizes = got.counts[got.first]
        cut = np.searchsorted(X.part_of(got.hash, parts), np.arange(parts + 1))
        flags = np.concatenate([np.unpackbits(np.frombuffer(bits[p], np.uint8), count=int(sizes[s:e].sum())) for p, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s]).astype(bool)
        begin = np.cumsum(sizes) - sizes
        at = np.repeat(got.starts, got.counts) + ragged(got.counts)
        flag = flags[np.repeat(begin[got.entry], got.counts) + ragged(got.counts)]
        flag |= np.repeat(got.owner > got.least[got.entry], got.counts)
        gone = covered(at[flag], n, len(got.buf))
    if whole_characters and gone.any():
        char = np.cumsum((got.buf & 0xC0) != 0x80) - 1
        gone = (np.bincount(char, gone) > 0)[char]
    keep = np.concatenate(([0], np.cumsum(~gone)))[got.offs]
    return [pa.array(np.diff(got.offs)), binary_array(got.buf[~gone], keep), span_lists(gone, got.offs)]


def dedup(docs: DataFrame, n: int = STRING_BYTES, id_col: str = "doc_id", text_col: str = "text",
          carry: Sequence[str] = (), whole_characters: bool = False) -> DataFrame:
    """(id, carry..., n_bytes, kept, spans) for each row: the bytes that stay
    and the maximal removed runs. With ``whole_characters`` a UTF-8 character
    that loses a byte goes whole, so that what is kept is text."""
    spread, parts = X.bucketed(docs, id_col, text_col, carry)
    shared = X.to_buckets(X.to_parts(spread, lambda b, t: anchors(b, t, n, parts)), X.shared_keys)
    bits = X.to_buckets(X.to_parts(spread, lambda b, t, a: fragments(b, t, a, n, parts), shared), lambda t: settle(t, n))
    return X.finish(spread, shared.unionByName(bits), lambda t, a: kept(t, a, n, parts, whole_characters),
                    "n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
