"""Benchmark decontamination by an FM-index over each shard of documents.

Words are runs of letters and digits after lower-casing A-Z. A window is 13
consecutive words of a benchmark item; an item of fewer words, but not none,
is one window. A shard is a slice of an Arrow batch. Its words become symbols;
words that no benchmark item has can be part of no occurrence, so the indexed
sequence keeps only the runs of benchmark words that are long enough, with a
separator between them. The shard's index has a suffix array (prefix
doubling), its Burrows-Wheeler transform in a wavelet matrix with rank counts,
and every ``SAMPLE``-th suffix position. All windows are searched backward at
once; occurrences are located by walking to a sampled position and merged to
removal spans.

The benchmark is the stated query set: it is read in blocks of at most
``BLOCK_BYTES`` of text, one after the other, each of which is sent to the
tasks and searched in all documents; texts aren't shuffled. Null texts have no words and items
without words have no windows; repeated rows are kept and each judged by
itself. Items of the same id count once; an item with a null id marks words
but cannot be named, so it isn't listed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlgrid.session import scratch_dir

from .textbuf import ALNUM, LOWER, buffer_of, hashed_words, prefix, ragged, returning, runs, slices, window_hash

WINDOW_WORDS = 13
BLOCK_BYTES = 8 << 20
SAMPLE = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector a level."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []  # ones before each place
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            count = np.zeros(len(seq) + 1, np.int64)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(seq) - int(count[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        begin, at = np.zeros_like(places), places
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbols >> (self.bits - 1 - k)) & 1).astype(bool)
            b, a = ones[begin], ones[at]
            begin, at = np.where(bit, zeros + b, begin - b), np.where(bit, zeros + a, at - a)
        return at - begin


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence whose last symbol is its least."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    n, step = len(seq), 1
    while True:
        later = np.full(n, -1, np.int64)
        later[:max(0, n - step)] = rank[step:]
        order = np.lexsort((later, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        step *= 2


class FMIndex:
    """Over symbols of 2 or more; 1 separates runs, 0 ends the sequence."""

    def __init__(self, seq: np.ndarray, top: int):
        seq = np.append(seq, 0)
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1]
        self.tree = WaveletMatrix(self.bwt, top)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=top + 1))))
        self.sampled = sa % SAMPLE == 0
        self.samples = sa[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.size = len(seq)

    def search(self, patterns: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each pattern; patterns are aligned at the right."""
        lo, hi = np.zeros(len(lens), np.int64), np.full(len(lens), self.size, np.int64)
        for k in range(patterns.shape[1]):
            on = np.flatnonzero((lens > k) & (lo < hi))
            c = patterns[on, -1 - k]
            lo[on] = self.before[c] + self.tree.rank(c, lo[on])
            hi[on] = self.before[c] + self.tree.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            hit = self.sampled[rows[left]]
            done = left[hit]
            out[done] = self.samples[self.sample_rank[rows[done]]] + steps[done]
            left = left[~hit]
            at = rows[left]
            c = self.bwt[at]
            rows[left] = self.before[c] + self.tree.rank(c, at)
            steps[left] += 1
        return out


class Phrases:
    """The windows of one block of benchmark items, as symbols; of each window
    the items that have it (by place in ``texts``), one window after the other."""

    def __init__(self, texts: Sequence[str | None], n: int):
        buf, offs = buffer_of(pa.array(texts, pa.large_string()))
        _, _, rows, hashes = hashed_words(buf, offs, ALNUM, fold=LOWER)
        self.vocab, symbols = np.unique(hashes, return_inverse=True)
        symbols = symbols + 2
        count = np.bincount(rows, minlength=len(texts))
        stop = np.cumsum(count)
        at = np.arange(len(rows))
        # every place with n words of its item behind it; else the item's begin
        at = at[(at + n <= stop[rows]) | (at == (stop - count)[rows])] if len(at) else at
        size = np.minimum(n, stop[rows[at]] - at)
        key = window_hash(prefix(hashes), at, at + size)
        order = np.lexsort((rows[at], key))
        key, owner = key[order], rows[at][order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        keep = new | np.concatenate(([True], owner[1:] != owner[:-1])) if len(key) else new  # an item counts once
        first = order[new]
        self.lens = size[first]
        place = at[first, None] + np.arange(n) - (n - self.lens[:, None])
        self.windows = np.where(np.arange(n) >= n - self.lens[:, None], symbols[np.maximum(place, 0)] if len(symbols) else 0, 0)
        window = np.cumsum(new) - 1
        self.owners = owner[keep]
        self.owner_cut = np.concatenate(([0], np.cumsum(np.bincount(window[keep], minlength=len(first)))))
        self.shortest = int(self.lens.min()) if len(first) else 0

    def items(self, window: int) -> list[int]:
        return self.owners[self.owner_cut[window]:self.owner_cut[window + 1]].tolist()

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]], set[int]]]:
        """(row, words, merged word spans, items) of the rows; words only where nothing occurs."""
        starts, _, rows, hashes = hashed_words(buf, offs, ALNUM, fold=LOWER)
        n_rows = len(offs) - 1
        count = np.bincount(rows, minlength=n_rows)
        base = np.cumsum(count) - count
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        if len(starts) and len(self.windows):
            at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
            symbol = np.where(self.vocab[at] == hashes, at + 2, 0)
            known = np.zeros(len(symbol) + n_rows, bool)  # a gap after each row ends its runs
            known[np.arange(len(symbol)) + rows] = symbol > 0
            a, b = runs(known)
            keep = b - a >= self.shortest
            a, b = a[keep], b[keep]
            if len(a):
                size = b - a + 1
                spot = np.repeat(a, size) + ragged(size)
                row_at = np.repeat(np.arange(n_rows), count + 1)
                word_at = np.minimum(spot - row_at[spot], len(symbol) - 1)
                seq = np.where(ragged(size) == np.repeat(size - 1, size), 1, symbol[word_at])
                index = FMIndex(seq, len(self.vocab) + 1)
                lo, hi = index.search(self.windows, self.lens)
                which = np.repeat(np.arange(len(lo)), hi - lo)
                first = word_at[index.locate(np.repeat(lo, hi - lo) + ragged(hi - lo))]
                delta = np.zeros(len(symbol) + 1, np.int64)
                np.add.at(delta, first, 1)
                np.add.at(delta, first + self.lens[which], -1)
                cover = np.cumsum(delta[:-1]) > 0
                fence = np.zeros(len(symbol) + n_rows, bool)
                fence[np.arange(len(symbol)) + rows] = cover
                for s, e in zip(*runs(fence)):
                    row = int(row_at[s])
                    spans.setdefault(row, []).append((int(s - row - base[row]), int(e - row - base[row])))
                for row, w in np.unique(np.stack((rows[first], which)), axis=1).T.tolist():
                    items.setdefault(row, set()).update(self.items(w))
        for row in range(n_rows):
            yield row, int(count[row]), spans.get(row, []), items.get(row, set())


SPANS = "array<struct<start:long,end:long>>"
FOUND = f"n_words long, spans {SPANS}, item_ids array<long>"
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass
class Block:
    """Items of the benchmark. A worker builds the windows when it first needs
    them; what travels is the items' text, ``BLOCK_BYTES`` at most."""
    ids: list[int | None]
    texts: list[str | None]
    n: int
    phrases: Phrases | None = None

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list, list[int]]]:
        """(words, merged spans, named items) of each text."""
        if self.phrases is None:
            self.phrases = Phrases(self.texts, self.n)
        _, offs = buffer_of(texts)
        for i, j in slices(offs):
            for _, count, spans, items in self.phrases.scan(*buffer_of(texts.slice(i, j - i))):
                yield count, [{"start": s, "end": e} for s, e in spans], sorted({self.ids[x] for x in items if self.ids[x] is not None})


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each row: ``carry`` columns, the text's number of words, merged spans
    of word positions inside occurrences, and the items that occur.

    A benchmark of several blocks is searched block by block: only one is held
    at a time, and what it finds is written to the shared folder by the text's
    digest (equal texts have equal spans), to be joined to the rows at the end."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))

    def block(k: int) -> Block:
        # by id and text, so that one id's many items don't make a block large
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        items = part.collect()
        return Block([r.item_id for r in items], [r.text for r in items], n)

    rows = docs.select(F.struct(*carry).alias("r"), F.col(text_col).alias("t"))
    if blocks == 1:
        return _all_rows(rows, block(0)).select("r.*", "n_words", "spans", "item_ids", F.size("item_ids").cast("long").alias("n_items"))
    folder, key = scratch_dir(spark, "decontamination"), F.sha2(F.coalesce("t", F.lit("")), 256).alias("key")
    _all_rows(rows.select(F.struct("r", key).alias("r"), "t"), block(0)).write.parquet(f"{folder}/rows")
    for k in range(1, blocks):
        _hits(rows.select(key, "t"), block(k)).dropDuplicates(["key"]).write.parquet(f"{folder}/hits/block={k}")
    more = (spark.read.parquet(f"{folder}/hits").groupBy("key")
            .agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("item_ids")).alias("more_items")))
    more.write.parquet(f"{folder}/more")  # so that the join can split a text that many rows share
    base = spark.read.parquet(f"{folder}/rows").select("r.r", "r.key", "n_words", "spans", "item_ids")
    met = base.join(spark.read.parquet(f"{folder}/more"), "key", "left")
    spans = F.concat("spans", F.coalesce("more_spans", F.array().cast(SPANS)))
    items = F.array_sort(F.array_distinct(F.concat("item_ids", F.coalesce("more_items", F.array().cast("array<long>")))))
    return met.select("r.*", "n_words", merged(spans).alias("spans"), items.alias("item_ids"), F.size(items).cast("long").alias("n_items"))


def merged(spans: F.Column) -> F.Column:
    """Spans that meet or overlap made one, ascending."""
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS),
                       lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= F.get(a, F.size(a) - 1)["end"]), joined(a, s)).otherwise(F.concat(a, F.array(s))))


def _all_rows(rows: DataFrame, block: Block) -> DataFrame:
    """(r, t) -> r and FOUND of every row."""
    schema = T.StructType([rows.schema.fields[0], *T._parse_datatype_string(FOUND).fields])
    shared = rows.sparkSession.sparkContext.broadcast(block)  # BLOCK_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*shared.value.scan(batch.column(1)))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(got, (pa.int64(), SPAN_ARROW, pa.list_(pa.int64()))))], names=schema.names)

    return rows.mapInArrow(returning(run), schema)


def _hits(rows: DataFrame, block: Block) -> DataFrame:
    """(key, t) -> key, spans and items of the texts in which something occurs."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [(k, spans, items) for k, (_, spans, items) in enumerate(shared.value.scan(batch.column(1))) if spans]
            at, spans, items = zip(*hit) if hit else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(spans, SPAN_ARROW), pa.array(items, pa.list_(pa.int64()))],
                                             names=["key", "spans", "item_ids"])

    return rows.mapInArrow(returning(run), f"key string, spans {SPANS}, item_ids array<long>")


def verdicts(found: DataFrame) -> DataFrame:
    """n_hit and the contamination rule (5 % of the words at least) beside the spans."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return (found.withColumn("n_hit", hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))))
