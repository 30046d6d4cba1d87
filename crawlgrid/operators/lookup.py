"""Projections, filters and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrid.constants import KNOWN_SETTING_KEYS, SETTING_PATTERNS


def projects_of(projects: DataFrame, owner_id: int) -> DataFrame:
    """Projects owned by one user."""
    return projects.where(F.col("owner_id") == owner_id)


def resolve_spiders(requests: DataFrame, projects: DataFrame, spiders: DataFrame,
                    by: str = "name") -> DataFrame:
    """(owner, project, spider name) requests → spider id or a reason.

    ``by='id'``: the project is one of the requesting owner's projects, by id
    (the web pages). ``by='name'``: the project is looked up by name alone,
    without an owner check, the lowest id winning on duplicate names (the
    REST API). 'project not found' is reported before 'spider not found';
    duplicate spider names inside one project resolve to the lowest id.
    """
    if by == "id":
        p = projects.select(F.col("id").alias("_pkey"), F.col("owner_id").alias("_owner"),
                            F.col("id").alias("resolved_project_id"))
        cond = (requests.project_id == p._pkey) & (requests.owner_id == p._owner)
    else:
        p = projects.groupBy(F.col("name").alias("_pkey")).agg(F.min("id").alias("resolved_project_id"))
        cond = requests.project_name == p._pkey
    s = (spiders.groupBy(F.col("project_id").alias("_sp_project"), F.col("name").alias("_sp_name"))
         .agg(F.min("id").alias("spider_id")))
    r = requests.join(p, cond, "left")
    r = r.join(s, (r.resolved_project_id == s._sp_project) & (r.spider_name == s._sp_name), "left")
    reason = (F.when(F.col("resolved_project_id").isNull(), F.lit("project not found"))
              .when(F.col("spider_id").isNull(), F.lit("spider not found")))
    return r.select("req_id", F.col("resolved_project_id").alias("project_id"), "spider_id",
                    reason.alias("reason"))


def visible_nodes(nodes: DataFrame) -> DataFrame:
    """Registered nodes, plus unregistered ones not deleted (NULL flag is not false)."""
    return nodes.where(F.col("node_key_id").isNotNull() | F.col("is_deleted").eqNullSafe(False))


def jobs_by_status(queue: DataFrame, status: int) -> DataFrame:
    """One status slice of the queue."""
    return queue.where(F.col("status") == status)


def status_code(word) -> F.Column:
    """completion status word → code; anything else is invalid (null)."""
    w = F.col(word) if isinstance(word, str) else word
    return F.when(w == "success", 2).when(w == "fail", 3)


def completable(completions: DataFrame, queue: DataFrame) -> DataFrame:
    """P5: accept a completion only for a queued job in status 1 or 5 owned by
    the reporting node (when a node is given). Unknown status words are
    rejected first."""
    q = queue.where(F.col("status").isin(1, 5)).select(
        F.col("id").alias("_qid"), F.col("node_id").alias("_qnode"))
    j = completions.join(q, (completions.job_id == q._qid)
                         & (completions.node_id.isNull() | (completions.node_id == q._qnode)), "left")
    code = status_code("status")
    reason = (F.when(code.isNull(), F.lit("invalid status"))
              .when(F.col("_qid").isNull(), F.lit("job not found")))
    return j.select(completions.columns + [code.alias("status_code"), reason.isNull().alias("accepted"),
                                           reason.alias("reason")])


def job_detail(history: DataFrame, spiders: DataFrame, projects: DataFrame,
               job_status: DataFrame) -> DataFrame:
    """Finished job with its project, spider and status name (status 6 has none)."""
    h = history.alias("h")
    s = spiders.select(F.col("id").alias("_sid"), F.col("project_id").alias("_spid"),
                       F.col("name").alias("spider"))
    p = projects.select(F.col("id").alias("_pid"), F.col("name").alias("project"))
    st = job_status.select(F.col("id").alias("_st"), F.col("name").alias("status_name"))
    return (h.join(s, h.spider_id == s._sid).join(p, F.col("_spid") == p._pid)
            .join(st, h.status == st._st, "left")
            .select(F.col("h.id").alias("job_id"), "project", "spider", "fire_time", "start_time",
                    "complete_time", "status", "status_name", "items_count"))


def job_status_of(ids: DataFrame, queue: DataFrame, history: DataFrame,
                  job_status: DataFrame) -> DataFrame:
    """Look a job up in the queue, then in history (queue wins)."""
    q = queue.select(F.col("id").alias("_qid"), F.col("status").alias("_qs"))
    h = history.select(F.col("id").alias("_hid"), F.col("status").alias("_hs"))
    st = job_status.select(F.col("id").alias("_st"), F.col("name").alias("status_name"))
    j = (ids.join(q, ids.job_id == q._qid, "left").join(h, ids.job_id == h._hid, "left"))
    status = F.coalesce("_qs", "_hs")
    src = F.when(F.col("_qid").isNotNull(), "queue").when(F.col("_hid").isNotNull(), "history")
    j = j.select("job_id", status.alias("status"), src.alias("source"))
    return j.join(st, j.status == st._st, "left").drop("_st")


def node_view(nodes: DataFrame) -> DataFrame:
    """The public node record."""
    return nodes.select(
        F.concat(F.lit("nodes/"), F.col("id").cast("string")).alias("name"),
        "id",
        F.col("name").alias("display_name"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        (F.col("isalive") > 0).alias("is_online"),
        "client_ip",
    )


def setting_violations(settings: DataFrame) -> DataFrame:
    """Setting rows whose key is unknown or whose value does not fully
    match the key's pattern (``\\d+`` for numeric keys, anything otherwise)."""
    spark = settings.sparkSession
    rules = F.broadcast(spark.createDataFrame(
        [(k, SETTING_PATTERNS.get(k, ".*")) for k in KNOWN_SETTING_KEYS],
        "rule_key string, pattern string"))
    j = settings.join(rules, settings.setting_key == rules.rule_key, "left")
    full = F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))
    bad_value = ~F.coalesce(F.regexp_like(F.col("value"), full), F.lit(False))
    reason = (F.when(F.col("rule_key").isNull(), F.lit("unknown key"))
              .when((F.col("pattern") != ".*") & bad_value, F.lit("bad value")))
    return (j.select(*settings.columns, reason.alias("reason"))
            .where(F.col("reason").isNotNull()))
