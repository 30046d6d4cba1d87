"""Which pending job a node is offered.

The reference walks the queue row by row and, per row, counts running jobs and
re-reads the spider's tag setting. Here every step is one set operation:

* J1 earliest pending per spider: a decomposable ``min`` (map-side partial
  aggregation, so a spider holding a third of the queue costs one row per
  task) joined back on (spider_id, fire_time), a well-spread key.
* J2 concurrency: one aggregate of running jobs, one join.
* J3 tag containment (a theta join) is reduced to *distinct tag sets* on both
  sides, matched by an equi-join on the tag and a count, then equi-joined back
  to spiders and nodes. No spider × node product is formed.
* J4 picks, per node tag set, the first candidate by (fire_time, id) across
  all matching spider tag sets, again without forming node × job pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrid.constants import RUNNING_LIMIT
from crawlgrid.functions.text import split_clean, split_list
from crawlgrid.operators.aggregates import dedupe_eav

EMPTY_SET = ""          # key of the empty tag set
SEP = "\u0001"          # joins a sorted tag set into one key


def earliest_pending(queue: DataFrame) -> DataFrame:
    """Queue rows whose (spider_id, fire_time) equals the spider's earliest
    pending fire_time. Like the reference, the outer side is not filtered on
    status and fire_time ties all qualify."""
    first = (queue.where(F.col("status") == 0).groupBy("spider_id")
             .agg(F.min("fire_time").alias("_first_fire")))
    return (queue.join(first, (queue.spider_id == first.spider_id)
                       & (queue.fire_time == first._first_fire), "left_semi"))


def under_concurrency(candidates: DataFrame, queue: DataFrame, limit: int = RUNNING_LIMIT) -> DataFrame:
    """Drop candidates whose spider already runs ``limit`` or more jobs."""
    running = (queue.where(F.col("status") == 1).groupBy("spider_id")
               .agg(F.count(F.lit(1)).alias("_running"))
               .where(F.col("_running") >= limit).select("spider_id"))
    return candidates.join(running, "spider_id", "left_anti")


def dispatchable(queue: DataFrame, limit: int = RUNNING_LIMIT) -> DataFrame:
    """J1 ∘ J2 in one pass: one conditional aggregate per spider gives both
    the earliest pending fire_time and the running count, then one semi join."""
    stats = (queue.groupBy("spider_id")
             .agg(F.min(F.when(F.col("status") == 0, F.col("fire_time"))).alias("_first_fire"),
                  F.count_if(F.col("status") == 1).alias("_running"))
             .where(F.col("_first_fire").isNotNull() & (F.col("_running") < limit)))
    return queue.join(stats, (queue.spider_id == stats.spider_id)
                      & (queue.fire_time == stats._first_fire), "left_semi")


def spider_tags(settings: DataFrame) -> DataFrame:
    """(spider_id, tags) from the spider's current 'tag' setting (lowest id
    wins on duplicates); blank parts dropped. Spiders without a row are absent
    (callers treat absent as the empty set)."""
    tag = dedupe_eav(settings.where(F.col("setting_key") == "tag"), "spider_id", "setting_key")
    return tag.select("spider_id", split_clean("value", ",").alias("tags"))


def set_key(tags: Column) -> Column:
    """Canonical key of a tag set: sorted distinct tags joined; '' when empty."""
    return F.array_join(F.array_sort(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>")))), SEP)


def _set_members(keys: DataFrame, key_col: str) -> DataFrame:
    return keys.where(F.col(key_col) != EMPTY_SET).select(
        key_col, F.explode(F.split(F.col(key_col), SEP, -1)).alias("tag"))


def match_tag_sets(spider_sets: DataFrame, node_sets: DataFrame) -> DataFrame:
    """(spider_set, node_set) pairs where the spider set ⊆ node set, both
    non-empty; or both empty. Inputs are *distinct* set keys."""
    s = spider_sets.select(F.col("spider_set")).distinct()
    n = node_sets.select(F.col("node_set")).distinct()
    members = _set_members(n, "node_set")
    spread = members.groupBy("tag").agg(F.count(F.lit(1)).alias("_sets"))
    # a spider set can only match node sets that have its rarest tag; a tag
    # that no node has leaves its sets without a match
    rarest = (_set_members(s, "spider_set").join(spread, "tag", "left").groupBy("spider_set")
              .agg(F.min(F.struct(F.coalesce("_sets", F.lit(0)).alias("_sets"), "tag")).alias("_r"))
              .where(F.col("_r._sets") > 0).select("spider_set", F.col("_r.tag").alias("tag")))
    inside = F.size(F.array_except(F.split("spider_set", SEP, -1), F.split("node_set", SEP, -1))) == 0
    subset = rarest.join(members, "tag").where(inside).select("spider_set", "node_set")
    both_empty = (s.where(F.col("spider_set") == EMPTY_SET)
                  .join(n.where(F.col("node_set") == EMPTY_SET),
                        F.col("spider_set") == F.col("node_set"))
                  .select("spider_set", "node_set"))
    return subset.unionByName(both_empty)


def node_sets(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("node_id"), set_key(split_list("tags")).alias("node_set"))


def tag_match(spiders: DataFrame, settings: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Which spiders' tags match which nodes': both empty, or all spider
    tags present on the node. Said by tag sets, of which there are few:
    ``sets`` has the matching (spider_set, node_set) pairs, ``spiders`` and
    ``nodes`` each one's set. A popular set costs one pair, not a row for
    each of its spiders and nodes."""
    st = spider_tags(settings)
    sp = (spiders.select(F.col("id").alias("spider_id"))
          .join(st, "spider_id", "left")
          .select("spider_id", set_key(F.col("tags")).alias("spider_set")))
    ns = node_sets(nodes)
    return {"sets": match_tag_sets(sp, ns), "spiders": sp, "nodes": ns}


def nodes_for_spiders(match: dict[str, DataFrame], spider_ids: DataFrame) -> DataFrame:
    """(spider_id, node_id) for the asked spiders of a J3 match."""
    return (match["spiders"].join(spider_ids.select("spider_id"), "spider_id", "left_semi")
            .join(match["sets"], "spider_set").join(match["nodes"], "node_set").select("spider_id", "node_id"))


def next_job_per_node(queue: DataFrame, settings: DataFrame, nodes: DataFrame,
                      asking: DataFrame, limit: int = RUNNING_LIMIT) -> DataFrame:
    """For each asking node, the job ``get_next_task`` would offer (first by
    fire_time, then id, among J1 ∘ J2 candidates whose spider tags match), each
    node evaluated on its own without claiming. Unknown nodes get an error.

    Output: node_id, job_id (NULL when none), has_job, error.
    """
    cand = dispatchable(queue, limit)
    st = spider_tags(settings)
    cand = (cand.join(st, "spider_id", "left")
            .select("id", "fire_time", set_key(F.col("tags")).alias("spider_set")))
    # best candidate per spider tag set (few sets; decomposable min_by)
    best_per_set = cand.groupBy("spider_set").agg(
        F.min(F.struct("fire_time", "id")).alias("_best"))
    ns = node_sets(nodes)
    pairs = match_tag_sets(best_per_set.select("spider_set"), ns.select("node_set"))
    best_per_node_set = (pairs.join(best_per_set, "spider_set").groupBy("node_set")
                         .agg(F.min("_best").alias("_best")))
    ask = asking.select("node_id").distinct()
    known = ask.join(ns, "node_id", "left").join(best_per_node_set, "node_set", "left")
    return known.select(
        "node_id",
        F.col("_best.id").alias("job_id"),
        (F.col("_best").isNotNull()).alias("has_job"),
        F.when(F.col("node_set").isNull(), F.lit("node not found")).alias("error"))
