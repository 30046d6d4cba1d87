"""Rounds between documents and keys, without a row for each occurrence.

Documents are dealt to buckets by a hash of the whole row, so neither a hot
source nor a group of copies fills one. A round sends the *distinct* keys of
each bucket (a bucket's copies are merged before the shuffle) to key
partitions, as packed arrays, and an answer for each key back to the buckets.
A key that is in every document therefore costs one entry a bucket. All
rounds read the same exchange of the documents: within one plan Spark
computes it once, and lost parts are computed again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbuf import give_back

# A bucket or key partition is handled in one piece, and each bucket sends each
# key partition one row: their number follows the input's bytes, whatever the
# number of shuffle partitions, so that neither memory nor the packed rows grow.
BUCKET_BYTES = 5 << 20
PARTS_PER_BUCKET = 0.5
LEAST_BUCKETS = 8
LAST = np.iinfo(np.int64).max  # stands for a null id: never smaller than another
BLOB = "b int, part int, kind int, data binary"
BLOB_ARROW = pa.schema([("b", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def bucketed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """(b, id, text, r) with ``carry`` columns in the struct r, and the number of
    key partitions. The texts' bytes are counted first."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(F.col(id_col), *carry).alias("r"))
    return df.withColumn("b", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")), max(1, int(n * PARTS_PER_BUCKET))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each 64-bit key; grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def blobs(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(BLOB_ARROW)], schema=BLOB_ARROW)


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("id").fill_null(LAST).to_numpy().astype(np.int64)


# -- keys that more than one document has -----------------------------------
def pack48(keys: np.ndarray, flag: np.ndarray) -> bytes:
    """The upper 47 bits of each key and a flag, six bytes each."""
    x = (keys >> np.uint64(17) << np.uint64(1)) | flag.astype(np.uint64)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def distinct_keys(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys by their upper 47 bits, whether several ids have it)."""
    short = keys >> np.uint64(17)
    order = np.argsort(short, kind="stable")
    short, ids, keys = short[order], ids[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1]))) if len(short) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)
    return keys[first], several


def key_blobs(b: int, kind: int, keys: np.ndarray, flags: np.ndarray, parts: int) -> list[tuple[int, int, int, bytes]]:
    """One packed row for each key partition; ``keys`` ascend."""
    cut = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    return [(b, p, kind, pack48(keys[s:e], flags[s:e])) for p, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s]


def shared_keys(table: pa.Table) -> pa.Table:
    """Of one key partition: to each bucket, those of its keys that documents share."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    bs = table.column("b").to_pylist()
    arrays = [unpack48(x.as_py()) for x in table.column("data")]
    keys = np.concatenate(arrays)
    who = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    order = np.argsort(keys >> np.uint64(1), kind="stable")
    k, f, who = keys[order] >> np.uint64(1), keys[order] & np.uint64(1), who[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.append(first, len(k)))
    shared = (size > 1) | (np.maximum.reduceat(f, first) > 0)
    on = np.repeat(shared, size)
    k, who = k[on], who[on]
    order = np.argsort(who, kind="stable")  # ascending keys within each bucket
    k, who = k[order], who[order]
    cut = np.searchsorted(who, np.arange(len(arrays) + 1))
    zero = np.zeros(len(k), bool)
    return blobs([(bs[i], part, kind, pack48(k[s:e] << np.uint64(17), zero[s:e])) for i, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s])


def answers(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(part, data) of one kind of answer, by part."""
    got = zip(table.column("part").to_pylist(), table.column("kind").to_pylist(), table.column("data"))
    return sorted(((p, d.as_py()) for p, k, d in got if k == kind), key=lambda x: x[0])


def known_keys(table: pa.Table, kind: int) -> np.ndarray:
    """The shared keys that came back, ascending (47 bits)."""
    got = [unpack48(d) >> np.uint64(1) for _, d in answers(table, kind)]
    return np.concatenate(got) if got else np.zeros(0, np.uint64)


def member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    short = keys >> np.uint64(17)
    return known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short


def _given_back(result: pa.Table) -> pa.Table:
    """What a bucket took is free by now; idle workers shouldn't hold it."""
    give_back()
    return result


def to_parts(docs: DataFrame, fn: Callable, answer: DataFrame | None = None) -> DataFrame:
    """``fn(b, table[, answers])`` over each bucket; it returns blob rows."""
    if answer is None:
        return docs.groupBy("b").applyInArrow(lambda t: _given_back(blobs(fn(t.column("b")[0].as_py(), t))), BLOB)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return _given_back(blobs(fn(left.column("b")[0].as_py(), left, right) if left.num_rows else []))

    return docs.groupBy("b").cogroup(answer.groupBy("b")).applyInArrow(both, BLOB)


def to_buckets(sent: DataFrame, fn: Callable) -> DataFrame:
    """``fn(table)`` over all blobs of each key partition; it returns blob rows."""
    return sent.groupBy("part").applyInArrow(lambda t: _given_back(fn(t)), BLOB)


def finish(docs: DataFrame, answer: DataFrame, fn: Callable, extra: str) -> DataFrame:
    """``fn(table, answers)`` gives the columns of ``extra`` for the rows of a bucket."""
    r = docs.schema["r"].dataType
    out = T.StructType([T.StructField("r", r), *T._parse_datatype_string(extra).fields])

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = fn(left, right) if left.num_rows else [[] for _ in out.fields[1:]]
        arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in cols]
        return _given_back(pa.Table.from_arrays([left.column("r"), *arrays], names=out.names))

    return docs.groupBy("b").cogroup(answer.groupBy("b")).applyInArrow(both, out).select("r.*", *out.names[1:])
