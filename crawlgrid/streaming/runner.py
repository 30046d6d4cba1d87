"""Running streams to a durable sink.

Every stream here writes to files under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``) with a checkpoint next to it, so a restarted query
(lost executor, lost driver) resumes from the last committed micro-batch.
Sinks are idempotent per batch id: file sinks are exactly-once, and the
``foreachBatch`` sinks overwrite the batch's own partition.
"""

from __future__ import annotations

import pickle
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crawlgrid.session import scratch_dir

EVENT_TIME = "event_time"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_time(df: DataFrame, col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Watermarked event-time column. Watermarks need TIMESTAMP (not NTZ); the
    session time zone is UTC, so the cast keeps wall-clock values."""
    return df.withColumn(EVENT_TIME, F.col(col).cast("timestamp")).withWatermark(EVENT_TIME, delay).observe(
        "arrived", F.count(F.lit(1)).alias("rows"), F.min(EVENT_TIME).alias("earliest"), F.max(EVENT_TIME).alias("latest"))


def millis(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[ns]").astype("int64").to_numpy() // 1_000_000


def timed_state(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Keyed state with event-time timers on RocksDB, which keeps large state on
    disk and writes changed entries alone."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


CHUNK = 1000  # rows of a key that wait together


class Waiting:
    """Times of a key that wait for the watermark. Those of a batch are an entry
    of a map by the least of them, at most ``CHUNK`` to each, so that a call
    costs an entry, not a row, and what waits isn't rewritten; an entry that
    the watermark cuts is. The caller keeps the entries' keys."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.chunks = handle.getMapState("waiting", "first long", "times array<long>")

    def put(self, keys: list[int], times: list[int]) -> list[int]:
        """``times`` ascend; the keys of all entries."""
        keys = set(keys)
        for k in range(0, len(times), CHUNK):
            piece = times[k:k + CHUNK]
            if piece[0] in keys:
                piece = sorted({*self.chunks.getValue((piece[0],))[0], *piece})
            self.chunks.updateValue((piece[0],), (piece,))
            keys.add(piece[0])
        return sorted(keys)

    def take(self, keys: list[int], before: int) -> tuple[list[int], list[int]]:
        """The times below ``before``, ascending, and the keys of what is left."""
        due, left, rest = set(), [k for k in keys if k >= before], []
        for first in keys:
            if first < before:
                times = self.chunks.getValue((first,))[0]
                self.chunks.removeKey((first,))
                due.update(t for t in times if t < before)
                rest += [t for t in times if t >= before]
        return sorted(due), self.put(left, sorted(set(rest))) if rest else left


BUCKETS = 4096


def bucketed_state(df: DataFrame, key: str, rows_of: Callable, step: Callable, schema: T.StructType) -> DataFrame:
    """Small keyed state with event-time deadlines for very many keys: a call
    handles the keys of a bucket, as one for each key costs more than its
    work. ``rows_of(frame)`` gives a frame's rows as tuples; ``step(key, held,
    rows, mark)`` is called for keys that have rows or whose deadline lies
    below the watermark ``mark``, and returns what is held (None: nothing),
    its next deadline and output rows. A bucket's keys are its state, on
    RocksDB; a batch writes the buckets that it or the watermark touches."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    names = schema.names

    def fn(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        keys = pickle.loads(state.get[0]) if state.exists else {}
        mark, new, out = state.getCurrentWatermarkMs(), {}, []
        if not state.hasTimedOut:
            for frame in frames:
                for k, row in zip(frame[key].tolist(), rows_of(frame)):
                    new.setdefault(k, []).append(row)
        for k in [*new, *(k for k, (_, due) in keys.items() if due < mark and k not in new)]:
            held, due, rows = step(k, keys.pop(k, (None, None))[0], new.get(k, ()), mark)
            out += rows
            if held is not None:
                keys[k] = (held, due)
        if keys:
            state.update((pickle.dumps(keys),))
            state.setTimeoutTimestamp(max(mark, min(due for _, due in keys.values()), 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket")
    return df.select("*", bucket).groupBy("_bucket").applyInPandasWithState(fn, schema, "keys binary", "append", "EventTimeTimeout")


class StreamCounts(StreamingQueryListener):
    """Rows read, rows that came behind the watermark and were dropped, rows in
    the state and rows written to it by each batch, by query name; kept up to
    date while the queries run.

    Use as a context manager: the counts stand when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows, self.late, self.state, self.updated, self.observed = Counter(), Counter(), {}, {}, {}
        self._running: set[str] = set()

    def __enter__(self) -> StreamCounts:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        for _ in range(600):  # the events of a query come one after the other
            if not self._running:
                break
            time.sleep(0.1)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self._running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[p.name] += p.numInputRows
        self.late[p.name] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        self.state[p.name] = sum(o.numRowsTotal for o in p.stateOperators)
        self.updated.setdefault(p.name, []).append(sum(o.numRowsUpdated for o in p.stateOperators))
        for metric, row in p.observedMetrics.items():
            self.observed.setdefault(p.name, []).append((p.batchId, metric, row.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._running.discard(str(event.runId))


def run_append(stream: DataFrame, name: str, trigger_once: bool = True) -> DataFrame:
    """Run an append-mode stream into a parquet sink; return the sink as a table."""
    spark = stream.sparkSession
    root = scratch_dir(spark, f"stream-{name}")
    w = (stream.writeStream.outputMode("append").format("parquet")
         .queryName(name).option("path", root + "/out").option("checkpointLocation", root + "/checkpoint"))
    q = (w.trigger(availableNow=True) if trigger_once else w).start()
    q.awaitTermination()
    return spark.read.parquet(root + "/out")


def run_batches(stream: DataFrame, name: str, fn: Callable[[DataFrame, int], DataFrame],
                output_mode: str = "append") -> DataFrame:
    """Run a stream with ``foreachBatch``: ``fn(batch_df, batch_id)`` turns each
    micro-batch (a static DataFrame) into output rows, written to the batch's
    own partition (so a replayed batch overwrites itself). Returns all output
    with its ``batch_id``."""
    spark = stream.sparkSession
    root = scratch_dir(spark, f"stream-{name}")
    out = root + "/out"

    def sink(batch: DataFrame, batch_id: int):
        res = fn(batch, batch_id)
        if res is not None:
            (res.withColumn("batch_id", F.lit(batch_id).cast("long"))
             .write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch_id={batch_id}"))

    q = (stream.writeStream.queryName(name).outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", root + "/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    try:
        return spark.read.parquet(out)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # no batch produced output
            return None
        raise


def latest_per_key(df: DataFrame, keys: list[str], value_cols: list[str]) -> DataFrame:
    """Fold update-mode output: the row of the latest batch per key."""
    return df.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in value_cols])


ROWS_PER_FILE = 1_000_000


def replay(df: DataFrame, time_col: str, parts: int = 4, jitter_seconds: int = 0) -> DataFrame:
    """A stream of ``df`` as a feed that arrives in ``parts`` files' worth of
    micro-batches, in order of time; with ``jitter_seconds`` rows come up to
    that much out of order. Rows of equal time arrive together."""
    spark = df.sparkSession
    cols = df.columns
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    if jitter_seconds:
        at = at + F.pmod(F.xxhash64(*[c for c in cols]), F.lit(jitter_seconds * 1_000_000))
    keyed = df.withColumn("_at", at)
    cuts = [k / parts for k in range(1, parts)]
    n, edges = keyed.agg(F.count("*"), F.percentile_approx("_at", F.array(*map(F.lit, cuts)), 10_000)).first()
    files = max(1, -(-n // (parts * ROWS_PER_FILE)))
    path = scratch_dir(spark, "feed")
    for k in range(parts):
        low = F.col("_at") >= edges[k - 1] if k and edges else F.lit(k == 0)
        high = F.col("_at") < edges[k] if edges and k < parts - 1 else F.lit(True)
        part = keyed.where(low & high) if k else keyed.where(F.col("_at").isNull() | high)
        part.select(*cols).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def arriving(*parts: DataFrame) -> DataFrame:
    """A stream of tables that arrive one after the other, a micro-batch each."""
    spark, path = parts[0].sparkSession, scratch_dir(parts[0].sparkSession, "feed")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
