"""Ranking, top-k and latest-per-group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlgrid.operators.ranking import row_number_within
from crawlgrid.constants import HISTORY_KEEP, NODE_KEY_LIFETIME, RECENT_FINISHED


def _purge_rank(history: DataFrame) -> DataFrame:
    # NULL spider_id is its own group; NULL complete_time sorts last; id breaks ties.
    w = Window.partitionBy("spider_id").orderBy(F.col("complete_time").desc_nulls_last(), "id")
    return history.withColumn("rank", F.row_number().over(w))


def history_to_purge(history: DataFrame, keep: int = HISTORY_KEEP, scan: int | None = None) -> DataFrame:
    """Per spider, the jobs ranked beyond ``keep`` by complete_time desc.

    They are the history without what stays (T2), an anti join on the job id
    (a uniform key), so no spider's whole history is sorted in one task. With
    ``scan`` only the slice keep+1 .. scan is taken, as one sweep of a
    repeated purge does; the bound becomes a WindowGroupLimit below the
    shuffle.
    """
    if scan is not None:
        r = _purge_rank(history)
        return r.where((F.col("rank") > keep) & (F.col("rank") <= scan)).drop("rank")
    stay = history_after_purge(history, keep).select(F.col("id").alias("_stay"))
    return history.join(stay, history.id == stay._stay, "left_anti")


def history_after_purge(history: DataFrame, keep: int = HISTORY_KEEP, scan: int | None = None) -> DataFrame:
    """What stays: each spider's first ``keep`` jobs. The rank bound becomes
    a WindowGroupLimit below the shuffle: a spider holding a third of all rows
    ships at most ``keep`` of them per map task. With ``scan`` (one slice of a
    repeated purge) the jobs beyond it stay, too."""
    if scan is None:
        return _purge_rank(history).where(F.col("rank") <= keep).drop("rank")
    gone = history_to_purge(history, keep, scan).select(F.col("id").alias("_gone"))
    return history.join(gone, history.id == gone._gone, "left_anti")


def last_run_per_spider(projects: DataFrame, spiders: DataFrame, history: DataFrame,
                        job_status: DataFrame, triggers: DataFrame) -> DataFrame:
    """The dashboard: each project's spiders with their latest run
    (by start_time, id), its status name upper-cased, items ('' for 0/null)
    and the trigger count. Projects without spiders keep one row."""
    last = (history.where(F.col("spider_id").isNotNull())
            .groupBy("spider_id")
            .agg(F.max_by(F.struct("start_time", "status", "items_count"),
                          F.struct("start_time", "id")).alias("last")))
    trig = triggers.groupBy("spider_id").agg(F.count(F.lit(1)).alias("trigger_count"))
    st = job_status.select(F.col("id").alias("_st"), F.upper("name").alias("last_status"))
    s = spiders.select(F.col("id").alias("spider_id"), F.col("project_id").alias("_sp_project"),
                       F.col("name").alias("spider_name"))
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    j = (p.join(s, p.project_id == s._sp_project, "left")
         .join(last, "spider_id", "left")
         .join(trig, "spider_id", "left")
         .join(st, F.col("last.status") == st._st, "left"))
    items = F.col("last.items_count")
    return j.select(
        "project_id", "project_name", "spider_id", "spider_name",
        F.col("last.start_time").alias("last_start_time"),
        "last_status",
        F.when(F.col("last").isNull(), F.lit(None))
         .when(F.coalesce(items, F.lit(0)) == 0, F.lit("")).otherwise(items.cast("string")).alias("last_items"),
        F.when(F.col("spider_id").isNull(), F.lit(None))
         .otherwise(F.coalesce("trigger_count", F.lit(0))).alias("trigger_count"),
    )


def recent_finished(history: DataFrame, k: int = RECENT_FINISHED) -> DataFrame:
    """T4: global top k by complete_time desc (TakeOrderedAndProject)."""
    return history.orderBy(F.col("complete_time").desc_nulls_last(), "id").limit(k)


def recent_jobs_per_spider(history: DataFrame, queue: DataFrame, k: int = 100) -> DataFrame:
    """T5: per spider, the k latest finished jobs by start_time, plus every
    queued job by update_time; ``rank <= k`` becomes a WindowGroupLimit."""
    wh = Window.partitionBy("spider_id").orderBy(F.col("start_time").desc_nulls_last(), F.col("id").desc())
    fin = (history.where(F.col("spider_id").isNotNull())
           .withColumn("rank", F.row_number().over(wh)).where(F.col("rank") <= k)
           .select("spider_id", F.col("id").alias("job_id"), F.lit("finished").alias("section"),
                   "status", "rank"))
    # every queued job is listed, so no limit applies: number them without
    # sending a spider's whole queue to one task
    run = (row_number_within(queue, ["spider_id"], [F.col("update_time").desc_nulls_last(), F.col("id").desc()])
           .select("spider_id", F.col("id").alias("job_id"), F.lit("queue").alias("section"),
                   "status", "rank"))
    return fin.unionByName(run)


def latest_package(packages: DataFrame) -> DataFrame:
    """Highest version per project."""
    return (packages.groupBy("project_id")
            .agg(F.max_by(F.struct("version", "id", "egg_version", "file_path"), "version").alias("p"))
            .select("project_id", "p.version", F.col("p.id").alias("package_id"),
                    "p.egg_version", "p.file_path"))


def next_webhook_job(webhook_jobs: DataFrame) -> DataFrame:
    """The lowest-id webhook job still pending (a top-1 report)."""
    return webhook_jobs.where(F.col("status") == 0).orderBy("id").limit(1)


def node_key_rotation(node_keys: DataFrame, as_of, lifetime_s: int = NODE_KEY_LIFETIME) -> DataFrame:
    """Among unused, undeleted keys in id order, stale ones before the
    first fresh key are deleted and that key is the usable one; with no
    fresh key every stale one is deleted and a new key is needed.

    The first fresh id is a scalar subquery (one value), not a join.
    """
    cutoff = F.timestamp_add("SECOND", F.lit(-lifetime_s), F.lit(as_of).cast("timestamp_ntz"))
    cand = node_keys.where(F.col("used_node_id").isNull() & (F.col("is_deleted") == F.lit(False)))
    fresh = F.col("create_at") >= cutoff
    first_fresh = cand.where(fresh).select(F.min("id")).scalar()
    acts = cand.select(
        F.col("id").alias("key_id"),
        F.when(F.col("id") == first_fresh, F.lit("use"))
         .when(first_fresh.isNull() | (F.col("id") < first_fresh), F.lit("delete")).alias("action"))
    need = (cand.where(fresh).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
            .select(F.lit(None).cast("long").alias("key_id"), F.lit("create").alias("action")))
    return acts.where(F.col("action").isNotNull()).unionByName(need)


def job_order_listing(settings: DataFrame, parameters: DataFrame, triggers: DataFrame) -> DataFrame:
    """A spider page's listings in display order: settings and parameters
    by key, triggers by id. ``pos`` is the 1-based place in the listing."""
    def ranked(df, kind, key, value, order):
        r = row_number_within(df, ["spider_id"], order, out="pos")
        return r.select("spider_id", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"),
                        F.col(value).alias("value"), "pos")
    return (ranked(settings, "setting", "setting_key", "value", ["setting_key", "id"])
            .unionByName(ranked(parameters, "parameter", "parameter_key", "value", ["parameter_key", "id"]))
            .unionByName(ranked(triggers, "trigger", "id", "cron_pattern", ["id"])))
