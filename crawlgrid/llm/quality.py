"""Quality classifier: hashed word and character n-gram vectors, averaged.

Supervised subword embeddings: each word and each character n-gram (3 to 5
bytes, a word's leading blank included) is hashed to one of ``BUCKETS`` rows
of a learned matrix; a document is the average of its rows, and a softmax over
two classes gives the score. Training is plain stochastic gradient descent in
numpy over a bounded sample of labelled rows (``max_train`` rows of least
hash, a documented parameter), made in one task. As the output is linear in
the average, scoring needs one number for each bucket: the row's difference
of the two class logits. These ``BUCKETS`` numbers, a size that never grows,
are sent to the tasks; whole texts are scored where they lie, no shuffle.

Null and empty texts have no features; their score is that of the bias.
Labels that are null or other than 0 and 1 are left out; of several labels of
one document the lowest holds. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbuf import BYTE_VALUES, PIECE_BYTES, SPACED, buffer_of, pieces, prefix, returning, slices, window_hash, words

BUCKETS = 1 << 18
DIM = 16
NGRAMS = (3, 4, 5)
MAX_TRAIN = 6000
EPOCHS = 4
RATE = 0.5


def features(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in the buffer, bucket) of each feature, one kind after the other."""
    starts, ends, _ = words(buf, offs, SPACED)
    plain = np.where(SPACED[buf], buf, np.uint8(32))
    pre = prefix(BYTE_VALUES[plain])
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    yield starts, (window_hash(pre, starts, ends) >> shift).astype(np.int64)
    blank = np.concatenate(([0], np.cumsum(~SPACED[buf])))
    row_end = np.repeat(offs[1:], np.diff(offs))
    for n in NGRAMS:
        at = np.arange(max(0, len(buf) - n + 1))
        at = at[(blank[at + n] == blank[at + 1]) & (at + n <= row_end[at])]
        yield at, (window_hash(pre, at, at + n) >> shift).astype(np.int64)


@dataclass
class Model:
    """One number for each bucket, and the bias: the logit of label 1."""
    weights: np.ndarray
    bias: float

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Of each row. Texts are cut at blanks, which changes no feature: the
        rest begins with the blank that its first word's n-grams include."""
        n = len(offs) - 1
        total, count = np.zeros(n), np.zeros(n)
        at, row_of = pieces(buf, offs, SPACED, PIECE_BYTES)
        for i, j in slices(at, PIECE_BYTES):
            part, cut, rows = buf[at[i]:at[j]], at[i:j + 1] - at[i], row_of[i:j]
            if not len(part):
                continue
            sums, ones = np.zeros(len(part)), np.zeros(len(part), np.int32)
            for place, bucket in features(part, cut):
                sums[place] += self.weights[bucket]
                ones[place] += 1
            csum, cone = np.concatenate(([0], np.cumsum(sums))), np.concatenate(([0], np.cumsum(ones)))
            total += np.bincount(rows, csum[cut[1:]] - csum[cut[:-1]], n)
            count += np.bincount(rows, cone[cut[1:]] - cone[cut[:-1]], n)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def bags(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each row's features, counted PIECE_BYTES at once, also
    within a row; cut as in ``Model.scores``, which changes no feature."""
    for i, j in slices(offs, PIECE_BYTES):
        part, rows = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        at, row_of = pieces(part, rows, SPACED, PIECE_BYTES)
        key = count = np.zeros(0, np.int64)
        for a, z in slices(at, PIECE_BYTES):
            if at[z] == at[a]:
                continue
            cut = at[a:z + 1] - at[a]
            place, bucket = map(np.concatenate, zip(*features(part[at[a]:at[z]], cut)))
            row = row_of[a + np.searchsorted(cut, place, "right") - 1]
            got = np.unique(row * BUCKETS + bucket, return_counts=True)
            if len(key):  # what the earlier pieces of a long row have, too, is added up
                both, back = np.unique(np.concatenate((key, got[0])), return_inverse=True)
                got = both, np.bincount(back, np.concatenate((count, got[1]))).astype(np.int64)
            key, count = got
        ends = np.searchsorted(key, np.arange(j - i + 1) * BUCKETS)
        for a, z in zip(ends[:-1], ends[1:]):
            c = count[a:z].astype(np.float32)
            yield (key[a:z] % BUCKETS).astype(np.int32), c / max(c.sum(), 1)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Bucket weights and bias from (buckets, shares) of each text."""
    rng = np.random.default_rng(7)
    table = (rng.random((BUCKETS, DIM), np.float32) - np.float32(0.5)) / DIM
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, total = 0, EPOCHS * len(texts)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(texts)):
            rate = np.float32(RATE * (1 - steps / total))
            steps += 1
            rows, share = texts[k]
            if not len(rows):
                continue
            mean = share @ table[rows]
            logit = mean @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[k]] -= 1
            grad = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            table[rows] -= rate * len(rows) ** 0.5 * share[:, None] * grad
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, hold_out: int = 5) -> Model:
    """Learn ``labels.quality`` from documents whose crc32(doc_id as text) mod
    ``hold_out`` isn't 0; at most ``max_train`` labelled documents."""
    marked = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % hold_out != 0))
              .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    # more ids than rows wanted: some labels may name no document
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_train rows: bounded
              .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_train).select("text", F.col("quality").cast("int").alias("quality")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            marks += batch.column(1).to_pylist()
            texts += bags(*buffer_of(batch.column(0)))
        if texts:
            weights, bias = train(texts, np.array(marks))
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"])

    got = sample.coalesce(1).mapInArrow(returning(run), "weights binary, bias double").collect()
    return Model(np.frombuffer(got[0].weights, np.float32), got[0].bias) if got else Model(np.zeros(BUCKETS, np.float32), 0.0)


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: Sequence[str] = ("doc_id",), out_col: str = "score") -> DataFrame:
    """``carry`` columns and the score of each row."""
    df = docs.select(F.struct(*carry).alias("r"), F.col(text_col).alias("t"))
    schema = T.StructType([df.schema.fields[0], T.StructField(out_col, T.DoubleType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(buf, offs))], names=["r", out_col])

    return df.mapInArrow(returning(run), schema).select("r.*", out_col)
