"""Importance resampling towards a target distribution.

Features are all runs of one and two words, hashed (crc32) to ``BUCKETS``; a
bucket's gain is the floored log ratio of its smoothed shares in the target and
in the source, a document's weight the floored mean of its features' gains,
its score the weight and a Gumbel draw from its id: the highest scores are a
sample without replacement in proportion to the weights.

Array-scored weights: tasks hash whole texts in numpy (the checksums of all
words of a slice advance a byte a step, a pair's from its first word's) and
count into one array a task; the sums are BUCKETS numbers, whatever the
input, and go back to the tasks as an array of gains. Numeric threshold
bisection: the scores are written once to the shared folder; exact count jobs
narrow the range of the score until the cutoff stands, then that of the ids
tied on it. Only what lies beyond the cutoff is range-partitioned for its
ranks. No row is sorted that isn't drawn, and nothing is collected but counts.

Null and empty texts have no words: weight 0, never drawn (fewer than
``least_words``). A null id counts as an empty text in the draw and as the
greatest id in ties. Rows that repeat a drawn id and score are told apart by
weight, then features, and ranked one after the other, up to the size of the
draw. Without target or source rows the gains come from the smoothing alone;
an empty table gives no rows. Texts of any length are hashed in slices cut at
words. Columns are carried in a struct, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlgrid.operators.ranking import row_number_within
from crawlgrid.session import scratch_dir

from .textbuf import ALNUM, LOWER, buffer_of, pieces, returning, slices, words

BUCKETS = 10_000
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
POINTS = 15  # thresholds that one count job tries
LONG_WORD = 64
SLICE = 512 << 10
NO_ID = np.iinfo(np.int64).max

_crc = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc = np.where(_crc & 1, (_crc >> 1) ^ np.uint32(0xEDB88320), _crc >> 1)
CRC = _crc
START = np.uint32(0xFFFFFFFF)


def advance(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states after each word's bytes, all words a byte a step."""
    lens = ends - starts
    order = np.argsort(-lens, kind="stable")
    at, out = starts[order], state[order]
    size = lens[order]
    many = int(np.searchsorted(-size, -LONG_WORD, "left"))  # words beyond LONG_WORD, one by one
    for k in range(many):
        out[k] = np.uint32(zlib.crc32(buf[at[k]:at[k] + size[k]], int(out[k] ^ START))) ^ START
    at, rest, size = at[many:], out[many:], size[many:]
    for pos in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -pos, "left"))
        s = rest[:m]
        rest[:m] = CRC[(s ^ buf[at[:m] + pos]) & 255] ^ (s >> 8)
    back = np.empty_like(out)
    back[order] = out
    return back


def features(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each word, row of each feature, bucket of each feature) of a slice."""
    at, row_of = pieces(buf, offs, ALNUM[LOWER], SLICE)
    last_row, last_state = -1, START
    for i, j in slices(at, SLICE):
        part = LOWER[buf[at[i]:at[j]]]
        s, e, piece = words(part, at[i:j + 1] - at[i], ALNUM)
        if not len(s):
            continue
        row = row_of[i + piece]
        state = advance(np.full(len(s), START, np.uint32), part, s, e)
        before, its_row = np.append(last_state, state[:-1]), np.append(last_row, row[:-1])
        pair = its_row == row
        spaced = CRC[(before[pair] ^ np.uint32(32)) & 255] ^ (before[pair] >> 8)
        double = advance(spaced, part, s[pair], e[pair])
        last_row, last_state = row[-1], state[-1]
        yield row, np.concatenate((row, row[pair])), ((np.concatenate((state, double)) ^ START) % BUCKETS).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, bucket in features(*buffer_of(batch.column(0))):
                total += np.bincount(bucket, minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    got = docs.select(F.col(text_col).alias("t")).mapInArrow(returning(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in got.collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floored thousandfold log ratio of the smoothed shares."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def gumbel(id_text: Column, seed: int = SEED) -> Column:
    """The floored thousandfold Gumbel draw that belongs to an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          carry: Sequence[str] = ("doc_id",), seed: int = SEED) -> DataFrame:
    """(r: ``carry``, id, n_words, n_features, weight, score) of every row."""
    df = docs.select(F.struct(*carry).alias("r"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    schema = T.StructType([*df.schema.fields[:2], *(T.StructField(c, T.LongType(), False) for c in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, total = (np.zeros(n, np.int64) for _ in range(3))
            for row, feature_row, bucket in features(*buffer_of(batch.column(2))):
                n_words += np.bincount(row, minlength=n)
                n_features += np.bincount(feature_row, minlength=n)
                total += np.bincount(feature_row, gain[bucket], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), pa.array(n_features),
                                              pa.array(total // np.maximum(n_features, 1))], names=schema.names)

    scored = df.mapInArrow(returning(run), schema)
    return scored.withColumn("score", F.col("weight") + gumbel(F.col("id").cast("string"), seed)).withColumn("id", F.coalesce("id", F.lit(NO_ID)))


def least_reaching(rows: DataFrame, value: Column, wanted: int) -> tuple[int, int] | None:
    """(least v with ``wanted`` rows of value <= v, how many lie below v), by
    exact counts at ever closer thresholds."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None or wanted <= 0:
        return None
    below = 0
    while low < high:
        span = high - low
        points = sorted({low + span * (k + 1) // (POINTS + 1) for k in range(POINTS)} | {low + (span - 1) // 2})
        got = rows.agg(*[F.count(F.when(value <= F.lit(p), 1)) for p in points]).first()
        for p, n in zip(points, got):
            if n >= wanted:
                high = p
                break
            low, below = p + 1, n
    return low, below


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (saved: it is read often) and rank: 1, 2, ... of the drawn by
    falling score, then id; null for the others."""
    fit = F.col("n_words") >= least_words
    size = percent * scored.where(fit).count() // 100
    cut = least_reaching(scored.where(fit).select("score"), -F.col("score"), size)
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    least, above = -cut[0], cut[1]
    last, _ = least_reaching(scored.where(fit & (F.col("score") == least)).select("id"), F.col("id"), size - above)
    chosen = fit & ((F.col("score") > least) | ((F.col("score") == least) & (F.col("id") <= last)))
    ranked = row_number_within(scored.where(chosen).withColumn("_all", F.lit(0)), ["_all"],
                               [F.desc("score"), "id", F.desc("weight"), F.desc("n_features")]).drop("_all")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    return ranked.unionByName(scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ("doc_id",),
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``carry`` columns, n_words, n_features, weight, score and rank of every row."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    path = scratch_dir(docs.sparkSession, "resample")
    weigh(docs, gain, id_col, text_col, carry, seed).write.parquet(path)
    got = draw(docs.sparkSession.read.parquet(path), percent, least_words)
    return got.select("r.*", "n_words", "n_features", "weight", "score", "rank")
