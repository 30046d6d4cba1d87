"""Aggregations. All are decomposable (count/min/max/max_by), so Spark
aggregates map-side before the shuffle and a hot spider costs one row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrid.constants import KEY_QUOTA, SETTING_DEFAULTS


def running_per_spider(queue: DataFrame) -> DataFrame:
    """A1: running jobs per spider."""
    return (queue.where(F.col("status") == 1).groupBy("spider_id")
            .agg(F.count(F.lit(1)).alias("running")))


def first_pending_per_spider(queue: DataFrame) -> DataFrame:
    """A2: earliest fire_time of pending jobs per spider."""
    return (queue.where(F.col("status") == 0).groupBy("spider_id")
            .agg(F.min("fire_time").alias("fire_time")))


def spiders_with_history(history: DataFrame) -> DataFrame:
    """A3: distinct spider ids in history (NULL is one value)."""
    return history.select("spider_id").distinct()


def dashboard_counts(users: DataFrame, nodes: DataFrame) -> DataFrame:
    """A4: users, alive nodes and all nodes, one row. Two global aggregates,
    each one row, joined as scalars."""
    n_users = users.select(F.count(F.lit(1))).scalar()
    return nodes.agg(
        n_users.alias("user_count"),
        F.count_if(F.col("isalive") == 1).alias("active_node_count"),
        F.count(F.lit(1)).alias("all_node_count"))


def spider_counts(spiders: DataFrame, history: DataFrame, triggers: DataFrame) -> DataFrame:
    """A5: history jobs and triggers per spider; spiders without any keep 0."""
    h = history.groupBy("spider_id").agg(F.count(F.lit(1)).alias("jobs_count"))
    t = triggers.groupBy("spider_id").agg(F.count(F.lit(1)).alias("triggers_count"))
    s = spiders.select(F.col("id").alias("spider_id"))
    return (s.join(h, "spider_id", "left").join(t, "spider_id", "left")
            .select("spider_id", F.coalesce("jobs_count", F.lit(0)).alias("jobs_count"),
                    F.coalesce("triggers_count", F.lit(0)).alias("triggers_count")))


def key_quota(user_keys: DataFrame, limit: int = KEY_QUOTA) -> DataFrame:
    """Keys per user and whether one more may be created."""
    return (user_keys.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("allowed", F.col("n") < limit))


def dedupe_eav(df: DataFrame, entity: str, key: str, value: str = "value") -> DataFrame:
    """One value per (entity, key): the row with the lowest id wins."""
    return df.groupBy(entity, key).agg(F.min_by(value, "id").alias(value))


def effective_settings(settings: DataFrame, spiders: DataFrame | None = None) -> DataFrame:
    """EAV rows → one map per spider, defaults filled in where a key is
    missing (and for a NULL tag). With ``spiders`` given, spiders without any
    setting row get the defaults too."""
    d = dedupe_eav(settings, "spider_id", "setting_key")
    m = (d.groupBy("spider_id")
         .agg(F.map_from_entries(F.collect_list(F.struct("setting_key", "value"))).alias("m")))
    if spiders is not None:
        m = spiders.select(F.col("id").alias("spider_id")).join(m, "spider_id", "left")
    defaults = F.create_map(*[x for k, v in SETTING_DEFAULTS.items() for x in (F.lit(k), F.lit(v))])
    merged = F.map_concat(defaults, F.coalesce("m", F.create_map().cast("map<string,string>")))
    # a NULL tag value falls back to '' as well
    merged = F.transform_values(merged, lambda k, v: F.when((k == "tag") & v.isNull(), F.lit("")).otherwise(v))
    return m.select("spider_id", merged.alias("settings"))


def next_package_version(projects: DataFrame, packages: DataFrame) -> DataFrame:
    """max(version) + 1 per project, 1 for a project without packages."""
    mx = packages.groupBy("project_id").agg(F.max("version").alias("_max"))
    p = projects.select(F.col("id").alias("project_id"))
    return (p.join(mx, "project_id", "left")
            .select("project_id", (F.coalesce("_max", F.lit(0)) + 1).alias("next_version")))


def job_item_counts(items: DataFrame, log_facts: DataFrame) -> DataFrame:
    """Item lines per job against the count the job's log reports."""
    c = items.groupBy("job_id").agg(F.count(F.lit(1)).alias("item_lines"))
    f = log_facts.select("job_id", F.col("items_count").alias("logged_items"))
    return (c.join(f, "job_id", "left")
            .withColumn("counts_agree", F.col("item_lines") == F.col("logged_items")))
