"""Reconciliation and lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrid.functions.cron import valid_patterns
from crawlgrid.functions.text import split_clean
from crawlgrid.operators.aggregates import dedupe_eav
from crawlgrid.sources.files import item_variant

_TS = "timestamp_ntz"


def _adopters(reports: DataFrame, queue: DataFrame) -> DataFrame:
    """For queue jobs without an owner, the first reporting node adopts them
    (by report time, then node id): the reference handles reports in order."""
    orphans = queue.where(F.col("node_id").isNull()).select(F.col("id").alias("job_id"))
    return (reports.join(orphans, "job_id", "left_semi").groupBy("job_id")
            .agg(F.min_by("node_id", F.struct("ts", "node_id")).alias("_adopter")))


def kill_list(reports: DataFrame, queue: DataFrame) -> DataFrame:
    """Reported (node, job) pairs the node must kill, with the reason:
    job unknown, owned by another node, or not running. A job without an
    owner is adopted by its first reporter."""
    q = queue.select(F.col("id").alias("job_id"), F.col("node_id").alias("_owner"),
                     F.col("status").alias("_status"))
    j = (reports.join(q, "job_id", "left").join(_adopters(reports, queue), "job_id", "left"))
    owner = F.coalesce("_owner", "_adopter")
    reason = (F.when(F.col("_status").isNull(), F.lit("job unknown"))
              .when(owner != F.col("node_id"), F.lit("other node"))
              .when(F.col("_status") != 1, F.lit("not running")))
    return (j.select("node_id", "job_id", reason.alias("reason"))
            .where(F.col("reason").isNotNull()))


def refresh_reported(reports: DataFrame, queue: DataFrame, as_of) -> DataFrame:
    """J5 second output: the queue after the reports: adopted jobs get their
    owner, jobs confirmed by their owner while running get update_time = as_of."""
    ad = _adopters(reports, queue)
    ok = (reports.join(queue.select(F.col("id").alias("job_id"), F.col("node_id").alias("_owner"),
                                    F.col("status").alias("_status")), "job_id")
          .join(ad, "job_id", "left")
          .where((F.coalesce("_owner", "_adopter") == F.col("node_id")) & (F.col("_status") == 1))
          .select("job_id").distinct().withColumn("_ok", F.lit(True)))
    q = queue.join(ad, queue.id == ad.job_id, "left").drop("job_id")
    q = q.join(ok, q.id == ok.job_id, "left").drop("job_id")
    return q.select(*[
        (F.coalesce("node_id", "_adopter").alias("node_id") if c == "node_id" else
         F.when(F.col("_ok"), F.lit(as_of).cast(_TS)).otherwise(F.col("update_time")).alias("update_time")
         if c == "update_time" else F.col(c))
        for c in queue.columns])


def orphan_jobs(queue: DataFrame, spiders: DataFrame, projects: DataFrame) -> DataFrame:
    """Queued jobs whose spider, or the spider's project, no longer exists."""
    s = spiders.select(F.col("id").alias("_sid"), F.col("project_id").alias("_spid"))
    p = projects.select(F.col("id").alias("_pid"))
    j = queue.join(s, queue.spider_id == s._sid, "left").join(p, F.col("_spid") == p._pid, "left")
    reason = (F.when(F.col("_sid").isNull(), F.lit("spider not found"))
              .when(F.col("_pid").isNull(), F.lit("project not found")))
    return (j.select(F.col("id").alias("job_id"), "spider_id", reason.alias("reason"))
            .where(F.col("reason").isNotNull()))


def fireable_triggers(triggers: DataFrame, spiders: DataFrame, projects: DataFrame) -> DataFrame:
    """Every trigger with its spider and project, or the reason it cannot fire."""
    s = spiders.select(F.col("id").alias("_sid"), F.col("project_id").alias("project_id"),
                       F.col("name").alias("spider_name"))
    p = projects.select(F.col("id").alias("_pid"), F.col("name").alias("project_name"))
    j = triggers.join(s, triggers.spider_id == s._sid, "left").join(p, F.col("project_id") == p._pid, "left")
    reason = (F.when(F.col("_sid").isNull(), F.lit("spider not found"))
              .when(F.col("_pid").isNull(), F.lit("project not found")))
    return j.select(F.col("id").alias("trigger_id"), "spider_id", "cron_pattern",
                    F.when(reason.isNull(), F.col("project_name")).alias("project_name"),
                    F.when(reason.isNull(), F.col("spider_name")).alias("spider_name"),
                    reason.alias("reason"))


def project_delete_set(project_ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """What deleting the given projects removes, per table, and what it
    leaves behind (settings, figures and webhook jobs keep their rows; the ORM
    only blanks their parent key).

    ``tables``: spiders, queue, parameters, triggers, history, packages and
    optionally settings, figures, webhook_jobs, project_package.
    """
    pid = project_ids.select(F.col("project_id"))
    spiders = tables["spiders"].join(pid, tables["spiders"].project_id == pid.project_id, "left_semi")
    sid = spiders.select(F.col("id").alias("_sid"))

    def by_spider(name, key="id", action="delete"):
        df = tables[name]
        return (df.join(sid, df.spider_id == sid._sid, "left_semi")
                .select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"),
                        F.lit(action).alias("action")))

    parts = [spiders.select(F.lit("spiders").alias("table"), F.col("id").cast("string").alias("key"),
                            F.lit("delete").alias("action"))]
    for name in ("queue", "parameters", "triggers", "history"):
        parts.append(by_spider(name))
    for name in ("packages", "project_package"):
        if name in tables:
            df = tables[name]
            key = "id" if "id" in df.columns else "project_id"
            parts.append(df.join(pid, df.project_id == pid.project_id, "left_semi").select(
                F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.lit("delete").alias("action")))
    for name in ("settings", "figures", "webhook_jobs"):
        if name in tables:
            parts.append(by_spider(name, action="left_behind"))
    parts.append(pid.select(F.lit("projects").alias("table"), F.col("project_id").cast("string").alias("key"),
                            F.lit("delete").alias("action")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def new_spiders(packages: DataFrame, spiders: DataFrame) -> DataFrame:
    """Spider names listed by a project's packages and not yet registered."""
    names = packages.select("project_id", F.explode(split_clean("spider_list", ",")).alias("name"))
    have = spiders.select("project_id", "name")
    return names.join(have, ["project_id", "name"], "left_anti").distinct()


def new_triggers(requests: DataFrame, triggers: DataFrame) -> DataFrame:
    """Outcome of (spider_id, cron) trigger requests: 'duplicate' when the
    exact text exists already (or an earlier request in the batch added it;
    no validation then), else 'accepted' when the pattern is valid, else
    'invalid'. Requests without a spider keep their resolution reason."""
    have = triggers.select(F.col("spider_id").alias("_tsid"), F.col("cron_pattern").alias("_tcron")).distinct()
    r = requests.join(have, (requests.spider_id == have._tsid) & (requests.cron == have._tcron), "left")
    r = valid_patterns(r, "cron", "_valid")
    # within the batch the first valid request of a new (spider, cron) adds it;
    # a decomposable min per key instead of a window over each key's rows
    first = (r.where(F.col("_valid") & F.col("_tsid").isNull() & F.col("spider_id").isNotNull())
             .groupBy("spider_id", "cron").agg(F.min("req_id").alias("_first")))
    r = r.join(first, ["spider_id", "cron"], "left")
    outcome = (F.when(F.col("spider_id").isNull(), F.coalesce(F.col("reason"), F.lit("spider not found")))
               .when(F.col("_tsid").isNotNull() | (F.col("req_id") > F.col("_first")), F.lit("duplicate"))
               .when(F.col("_valid"), F.lit("accepted")).otherwise(F.lit("invalid")))
    return r.select("req_id", "spider_id", "cron", outcome.alias("outcome"))


FIGURE_SCHEMA = ("spider_name string, spider string, project_name string, extra_requirements string, "
                 "settings map<string,string>, spider_parameters map<string,string>, "
                 "base_settings_module string, output string, plugin_settings string, plugins string, package string")


def requirements(value: Column) -> Column:
    """A figure's requirements: a JSON list as it is, a string split on ';'."""
    is_list = F.startswith(F.ltrim(value), F.lit("["))
    return F.when(is_list, F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))).otherwise(split_clean(value, ";"))


def stored_figure(text: Column) -> Column:
    """A figure's JSON as a struct; NULL unless it is one strict JSON object.
    Put it into a column of its own: it is parsed for each row once then."""
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    return F.when(item_variant(text).isNotNull(), F.from_json(text, FIGURE_SCHEMA, strict))


def figure(stored: Column, spider_name: Column, parameters: Column) -> Column:
    """the run figure from a stored one (``stored_figure``; NULL counts as
    empty): spider := the spider's name, parameters (``settings`` first if
    non-empty, else ``spider_parameters``) overlaid by the spider's parameter
    rows, requirements as a list, or split on ';'. Plugin settings and plugins
    are JSON text ('{}' and '[]' when missing)."""
    f = stored
    empty = F.create_map().cast("map<string,string>")
    given = F.when(F.size(f["settings"]) > 0, f["settings"]).otherwise(F.coalesce(f["spider_parameters"], empty))
    params = F.map_concat(F.coalesce(given, empty), F.coalesce(parameters, empty))
    return F.struct(
        spider_name.alias("spider"),
        f["project_name"].alias("project_name"),
        requirements(f["extra_requirements"]).alias("extra_requirements"),
        params.alias("spider_parameters"),
        params.alias("settings"),
        f["base_settings_module"].alias("base_settings_module"),
        F.coalesce(f["plugin_settings"], F.lit("{}")).alias("plugin_settings"),
        F.coalesce(f["plugins"], F.lit("[]")).alias("plugins"),
        f["package"].alias("package"),
        f["output"].alias("output"))


def _first_figures(figures: DataFrame) -> DataFrame:
    """(spider_id, _stored) of the figure that holds for each spider, parsed."""
    first = dedupe_eav(figures.withColumn("_k", F.lit("figure")), "spider_id", "_k", "text")
    return first.select("spider_id", stored_figure(F.col("text")).alias("_stored"))


def spider_figures(spiders: DataFrame, parameters: DataFrame, figures: DataFrame) -> DataFrame:
    """F11 for every stored figure: the run figure of its spider."""
    s = spiders.select(F.col("id").alias("_sid"), F.col("name").alias("_sname"))
    j = _first_figures(figures).join(params_map(parameters), "spider_id", "left").join(s, F.col("spider_id") == F.col("_sid"))
    return j.select("spider_id", figure(F.col("_stored"), F.col("_sname"), F.col("params")).alias("figure"))


def params_map(parameters: DataFrame) -> DataFrame:
    """spider_parameters EAV → (spider_id, map); lowest id wins on duplicates."""
    d = dedupe_eav(parameters, "spider_id", "parameter_key")
    return d.groupBy("spider_id").agg(
        F.map_from_entries(F.collect_list(F.struct("parameter_key", "value"))).alias("params"))


def job_payload(jobs: DataFrame, spiders: DataFrame, projects: DataFrame, settings: DataFrame,
                parameters: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """What a node receives for a job: ids and names, project version,
    extra requirements, spider parameters overlaid by the job's own
    ``settings.spider_parameters``, and the figure. Jobs whose spider or
    project is gone are not delivered (see J6)."""
    s = spiders.select(F.col("id").alias("_sid"), F.col("project_id").alias("_spid"))
    p = projects.select(F.col("id").alias("_pid"), F.col("version"))
    req = (dedupe_eav(settings.where(F.col("setting_key") == "extra_requirements"), "spider_id", "setting_key")
           .select(F.col("spider_id").alias("_rsid"), split_clean("value", ";").alias("extra_requirements")))
    pm = params_map(parameters).withColumnRenamed("spider_id", "_psid")
    # one row per spider first (the project join last, so that both sides of
    # the join with the jobs are shuffled for it and a hot spider can be split);
    # the jobs are shuffled once
    sp = s.join(req, F.col("_sid") == F.col("_rsid"), "left").join(pm, F.col("_sid") == F.col("_psid"), "left")
    if figures is not None:
        sp = sp.join(_first_figures(figures).withColumnRenamed("spider_id", "_fsid"), F.col("_sid") == F.col("_fsid"), "left")
    else:
        sp = sp.withColumn("_stored", F.from_json(F.lit(None).cast("string"), FIGURE_SCHEMA))
    # the figure depends on the spider alone, but for the name that the job gives it
    sp = sp.withColumn("_figure", figure(F.col("_stored"), F.lit(None).cast("string"), F.col("params")))
    sp = sp.select("_sid", "_spid", "extra_requirements", "params", "_figure").join(p, F.col("_spid") == p._pid)
    j = jobs.join(sp, jobs.spider_id == F.col("_sid"))
    empty = F.create_map().cast("map<string,string>")
    job_params = F.from_json(F.col("settings"), "spider_parameters map<string,string>")["spider_parameters"]
    return j.select(
        F.col("id").alias("task_id"), "spider_id", "spider_name", "project_name", "version",
        F.coalesce("extra_requirements", F.array().cast("array<string>")).alias("extra_requirements"),
        F.map_concat(F.coalesce("params", empty), F.coalesce(job_params, empty)).alias("spider_parameters"),
        F.col("_figure").withField("spider", F.col("spider_name")).alias("figure"))


def spider_jobs_with_webhook(history: DataFrame, webhook_jobs: DataFrame, job_status: DataFrame) -> DataFrame:
    """Finished jobs with their webhook deliveries (if any) and status names."""
    w = webhook_jobs.select(F.col("id").alias("webhook_id"), F.col("job_id").alias("_wjob"),
                            F.col("status").alias("webhook_status"))
    st = job_status.select(F.col("id").alias("_st"), F.col("name").alias("webhook_status_name"))
    return (history.join(w, history.id == w._wjob, "left")
            .join(st, F.col("webhook_status") == st._st, "left")
            .select(F.col("id").alias("job_id"), "spider_id", "status", "webhook_id", "webhook_status",
                    "webhook_status_name"))
