"""X4 cron fires per micro-batch, X6 item ingest, X7 completion feed / alerts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgrid.functions.cron import cron_fires
from crawlgrid.operators.joins import fireable_triggers
from crawlgrid.operators.lifecycle import enqueue
from crawlgrid.operators.sinks import completion_feed, failed_job_alerts
from crawlgrid.sources.files import SMALL_FILE, job_file_index, long_lines, pack_folder, parse_items, whole_lines


def cron_fire_batches(triggers: DataFrame, spiders: DataFrame, projects: DataFrame, settings: DataFrame, ends: str,
                      clock_col: str = "ts") -> Callable[[DataFrame, int], DataFrame]:
    """For each micro-batch of a clock stream, the fires of every fireable
    trigger (F2) from the end of the batch before to this batch's last tick,
    enqueued (L1): full queue rows, fired at their minute. The id is the md5 of
    trigger and fire minute, so a replayed batch enqueues the same ids, and a
    sink that replaces the batch's partition is an upsert. The first batch
    begins at its first tick. Each batch leaves one pointer in the folder
    ``ends``, its end, and reads that of the batch before; ticks older than it
    fire nothing. Spans are scalars; triggers, spiders and settings stay
    tables."""
    ok = fireable_triggers(triggers, spiders, projects).where(F.col("reason").isNull()).select(
        F.col("trigger_id").alias("id"), "spider_id", "cron_pattern")

    def fn(batch: DataFrame, batch_id: int) -> DataFrame | None:
        first, last = batch.agg(F.min(clock_col), F.max(clock_col)).first()
        spark = batch.sparkSession
        before = spark.read.parquet(f"{ends}/batch_id={batch_id - 1}").first()[0] if batch_id else None
        begin = before or first
        end = max((x for x in (before, last) if x is not None), default=None)
        (spark.range(1).select(F.lit(end).cast("timestamp_ntz").alias("end"))
         .coalesce(1).write.mode("overwrite").parquet(f"{ends}/batch_id={batch_id}"))
        if begin is None:
            return None

        def fires(met: DataFrame) -> DataFrame:
            key = F.concat_ws("@", F.col("id").cast("string"), F.col("fire_time").cast("string"))
            return cron_fires(met, str(begin), str(end), patterns=ok).withColumn("req_key", key).withColumnRenamed("fire_time", "_at")

        # a trigger meets its spider once, before it becomes its fires
        return enqueue(ok.withColumn("settings", F.lit(None).cast("string")), spiders, projects, settings, F.col("_at"), fires)
    return fn


def item_file_stream(spark: SparkSession, root: str, max_files: int, glob: str = "*.jl", max_packs: int | None = None) -> DataFrame:
    """X6 source: the item files that arrive under ``root``, at most ``max_files``
    a micro-batch, as (path, length, content); with ``max_packs`` also the
    files in packs, of at most that many packs a micro-batch."""
    files = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
            .option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
            .load(root).select("path", "length", "content"))
    if max_packs is None:
        return files
    packs = (spark.readStream.schema("path string, lines long, length long, content binary").option("maxFilesPerTrigger", max_packs)
             .parquet(pack_folder(root, "items")).where(F.col("content").isNotNull()).select("path", "length", "content"))
    return files.unionByName(packs)


def item_ingest(store: str, small_file: int = SMALL_FILE) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function with two sinks under ``store``, the items of
    a micro-batch's files (read as S2 does: small files whole, from the batch,
    longer ones split by bytes) and each file's counts. A batch writes its own
    partition of both, so a replayed batch replaces what it wrote; nothing is
    kept in the stream's state. Spark's file sources pass over empty files, so
    such a job has neither items nor a count."""
    keys = ["project", "spider", "job_id"]

    def fn(batch: DataFrame, batch_id: int) -> None:
        spark, here = batch.sparkSession, f"batch_id={batch_id}"
        # lengths and paths only: contents aren't read for this; max_files at most
        long = [r.path for r in batch.where(F.col("length") > small_file).select("path").collect()]
        lines = whole_lines(batch.where(F.col("length") <= small_file))
        if long:
            escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in long]
            lines = lines.unionByName(long_lines(spark, escaped, least=small_file).drop("charset"))
        items = parse_items(job_file_index(lines).where(F.col("kind") == "items").select(*keys, "line_no", F.col("line").alias("raw")))
        items.drop("item").write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/items/{here}")
        (spark.read.parquet(f"{store}/items/{here}").groupBy(*keys)
         .agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("bad_lines"))
         .write.mode("overwrite").parquet(f"{store}/counts/{here}"))
    return fn


_COUNTS = "project string, spider string, job_id string, lines long, bad_lines long, batch_id long"
_ITEMS = "project string, spider string, job_id string, line_no long, raw string, bad boolean, batch_id long"


def ingested_counts(spark: SparkSession, store: str) -> DataFrame:
    """(project, spider, job_id, lines, bad_lines, batch_id) of each job's latest file."""
    got = spark.read.schema(_COUNTS).option("basePath", f"{store}/counts").parquet(f"{store}/counts")
    last = F.max_by(F.struct("lines", "bad_lines", "batch_id"), "batch_id")
    return got.groupBy("project", "spider", "job_id").agg(last.alias("_l")).select("project", "spider", "job_id", "_l.*")


def ingested_items(spark: SparkSession, store: str) -> DataFrame:
    """The items of each job's latest file, parsed as in S2: a file that came
    again replaces the earlier one, as an upload does."""
    got = spark.read.schema(_ITEMS).option("basePath", f"{store}/items").parquet(f"{store}/items")
    keys = ["project", "spider", "job_id", "batch_id"]
    counts = spark.read.schema(_COUNTS).option("basePath", f"{store}/counts").parquet(f"{store}/counts")
    if not counts.groupBy(*keys[:3]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        got = got.join(ingested_counts(spark, store).select(*keys), keys, "left_semi")
    return parse_items(got.drop("batch_id", "bad"))


def completion_feed_stream(finished: DataFrame, spiders: DataFrame, projects: DataFrame,
                           settings: DataFrame) -> DataFrame:
    """Webhook posts for finished jobs as they arrive (stream-static joins)."""
    return completion_feed(finished, spiders, projects, settings)


def alert_stream(finished: DataFrame, spiders: DataFrame, projects: DataFrame,
                 enabled: bool, receiver: str) -> DataFrame:
    """Failure mails for finished jobs as they arrive."""
    return failed_job_alerts(finished, spiders, projects, enabled, receiver)


def observer_batches(observer: Callable[[DataFrame, int], None] | None = None):
    """X7 hook: a ``foreachBatch`` function that hands every micro-batch of
    finished-job rows to the user's observer and passes the rows on."""
    def fn(batch: DataFrame, batch_id: int) -> DataFrame:
        if observer is not None:
            observer(batch, batch_id)
        return batch
    return fn
