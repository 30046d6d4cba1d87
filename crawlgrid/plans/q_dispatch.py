"""Registered queries for dispatch and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlgrid.operators import dispatch as D
from crawlgrid.operators import joins as J
from crawlgrid.operators.lookup import resolve_spiders
from crawlgrid.plans.q_functions import _d_valid
from crawlgrid.plans.registry import register
from crawlgrid.sources.adapters import ANCHOR, DriverTables
from crawlgrid.sources.catalog import job_status


def _t(spark, sf):
    return DriverTables(spark, sf)


_J1 = """j1 AS (SELECT q.* FROM v_queue q
       JOIN (SELECT spider_id, min(fire_time) AS f FROM v_queue WHERE status = 0 GROUP BY 1) a
         ON q.spider_id = a.spider_id AND q.fire_time = a.f)"""
_J2 = """j2 AS (SELECT * FROM j1 WHERE NOT EXISTS (
       SELECT 1 FROM v_queue r WHERE r.status = 1 AND r.spider_id = j1.spider_id))"""
_STAGS = """stags AS (SELECT spider_id, list_filter(string_split(coalesce(arg_min(value, id), ''), ','),
                        lambda x: x <> '') AS st FROM v_settings WHERE setting_key = 'tag' GROUP BY 1)"""
_NTAGS = """ntags AS (SELECT id, CASE WHEN len(tags) = 1
                     THEN list_filter(string_split(tags[1], ','), lambda x: x <> '')
                     ELSE coalesce(tags, CAST([] AS VARCHAR[])) END AS nt FROM v_nodes)"""
_MATCH = "((len(st) = 0 AND len(nt) = 0) OR (len(st) > 0 AND len(nt) > 0 AND list_has_all(nt, st)))"


@register("J1_earliest_pending", f"WITH {_J1} SELECT * FROM j1")
def q_j1(spark, sf):
    return D.earliest_pending(_t(spark, sf).queue)


@register("J2_under_concurrency", f"WITH {_J1}, {_J2} SELECT * FROM j2")
def q_j2(spark, sf):
    q = _t(spark, sf).queue
    return D.under_concurrency(D.earliest_pending(q), q, 1)


def _set_sql(c):
    return f"array_to_string(list_sort(list_distinct({c})), '{D.SEP}')"


_J3_SP = """sp AS (SELECT s.id AS spider_id, coalesce(t.st, CAST([] AS VARCHAR[])) AS st
       FROM v_spiders s LEFT JOIN stags t ON t.spider_id = s.id)"""


def _match(spark, sf):
    t = _t(spark, sf)
    return D.tag_match(t.spiders, t.settings, t.nodes)


@register("J3_tag_match", f"""
WITH {_STAGS}, {_NTAGS}, {_J3_SP},
ss AS (SELECT DISTINCT list_sort(list_distinct(st)) AS st FROM sp),
ns AS (SELECT DISTINCT list_sort(list_distinct(nt)) AS nt FROM ntags)
SELECT {_set_sql("st")} AS spider_set, {_set_sql("nt")} AS node_set FROM ss, ns WHERE {_MATCH}
""")
def q_j3(spark, sf):
    return _match(spark, sf)["sets"]


@register("J3_spider_sets", f"WITH {_STAGS}, {_J3_SP} SELECT spider_id, {_set_sql('st')} AS spider_set FROM sp")
def q_j3s(spark, sf):
    return _match(spark, sf)["spiders"]


@register("J3_node_sets", f"WITH {_NTAGS} SELECT id AS node_id, {_set_sql('nt')} AS node_set FROM ntags")
def q_j3n(spark, sf):
    return _match(spark, sf)["nodes"]


@register("J4_next_job_per_node", f"""
WITH {_J1}, {_J2}, {_STAGS}, {_NTAGS},
cand AS (SELECT j2.id, j2.fire_time, coalesce(t.st, CAST([] AS VARCHAR[])) AS st
         FROM j2 LEFT JOIN stags t ON t.spider_id = j2.spider_id),
ask AS (SELECT DISTINCT node_id FROM v_beats),
best AS (SELECT n.id AS node_id, c.id AS job_id,
                row_number() OVER (PARTITION BY n.id ORDER BY c.fire_time, c.id) AS rn
         FROM ntags n JOIN cand c ON {_MATCH})
SELECT a.node_id, b.job_id, b.job_id IS NOT NULL AS has_job,
       CASE WHEN n.id IS NULL THEN 'node not found' END AS error
FROM ask a LEFT JOIN ntags n ON n.id = a.node_id
LEFT JOIN best b ON b.node_id = a.node_id AND b.rn = 1
""")
def q_j4(spark, sf):
    t = _t(spark, sf)
    return D.next_job_per_node(t.queue, t.settings, t.nodes, t.beats)


_ADOPT = """ad AS (SELECT job_id, node_id AS adopter FROM (
      SELECT r.job_id, r.node_id, row_number() OVER (PARTITION BY r.job_id ORDER BY r.ts, r.node_id) AS rn
      FROM v_reports r JOIN v_queue q ON q.id = r.job_id WHERE q.node_id IS NULL) WHERE rn = 1)"""


@register("J5_kill_list", f"""
WITH {_ADOPT}
SELECT * FROM (
  SELECT r.node_id, r.job_id,
         CASE WHEN q.id IS NULL THEN 'job unknown'
              WHEN coalesce(q.node_id, ad.adopter) <> r.node_id THEN 'other node'
              WHEN q.status <> 1 THEN 'not running' END AS reason
  FROM v_reports r LEFT JOIN v_queue q ON q.id = r.job_id LEFT JOIN ad ON ad.job_id = r.job_id)
WHERE reason IS NOT NULL
""")
def q_j5(spark, sf):
    t = _t(spark, sf)
    return J.kill_list(t.reports, t.queue)


@register("J5_refreshed_queue", f"""
WITH {_ADOPT},
ok AS (SELECT DISTINCT r.job_id FROM v_reports r JOIN v_queue q ON q.id = r.job_id
       LEFT JOIN ad ON ad.job_id = r.job_id
       WHERE coalesce(q.node_id, ad.adopter) = r.node_id AND q.status = 1)
SELECT q.* REPLACE (coalesce(q.node_id, ad.adopter) AS node_id,
                    CASE WHEN ok.job_id IS NOT NULL THEN TIMESTAMP '{ANCHOR}' ELSE q.update_time END AS update_time)
FROM v_queue q LEFT JOIN ad ON ad.job_id = q.id LEFT JOIN ok ON ok.job_id = q.id
""")
def q_j5b(spark, sf):
    t = _t(spark, sf)
    return J.refresh_reported(t.reports, t.queue, ANCHOR)


@register("J6_orphan_jobs", """
SELECT * FROM (
  SELECT q.id AS job_id, q.spider_id,
         CASE WHEN s.id IS NULL THEN 'spider not found' WHEN p.id IS NULL THEN 'project not found' END AS reason
  FROM v_queue q LEFT JOIN v_spiders s ON s.id = q.spider_id LEFT JOIN v_projects p ON p.id = s.project_id)
WHERE reason IS NOT NULL
""")
def q_j6(spark, sf):
    t = _t(spark, sf)
    return J.orphan_jobs(t.queue, t.spiders, t.projects)


@register("J7_fireable_triggers", """
SELECT t.id AS trigger_id, t.spider_id, t.cron_pattern,
       CASE WHEN s.id IS NOT NULL AND p.id IS NOT NULL THEN p.name END AS project_name,
       CASE WHEN s.id IS NOT NULL AND p.id IS NOT NULL THEN s.name END AS spider_name,
       CASE WHEN s.id IS NULL THEN 'spider not found' WHEN p.id IS NULL THEN 'project not found' END AS reason
FROM v_triggers t LEFT JOIN v_spiders s ON s.id = t.spider_id LEFT JOIN v_projects p ON p.id = s.project_id
""")
def q_j7(spark, sf):
    t = _t(spark, sf)
    return J.fireable_triggers(t.triggers, t.spiders, t.projects)


@register("J8_project_delete_set", """
WITH pid AS (SELECT id AS project_id FROM v_projects WHERE owner_id = 3),
sp AS (SELECT id FROM v_spiders WHERE project_id IN (SELECT project_id FROM pid))
SELECT 'spiders' AS "table", CAST(id AS VARCHAR) AS key, 'delete' AS action FROM sp
UNION ALL SELECT 'queue', id, 'delete' FROM v_queue WHERE spider_id IN (SELECT id FROM sp)
UNION ALL SELECT 'parameters', CAST(id AS VARCHAR), 'delete' FROM v_parameters WHERE spider_id IN (SELECT id FROM sp)
UNION ALL SELECT 'triggers', CAST(id AS VARCHAR), 'delete' FROM v_triggers WHERE spider_id IN (SELECT id FROM sp)
UNION ALL SELECT 'history', id, 'delete' FROM v_history WHERE spider_id IN (SELECT id FROM sp)
UNION ALL SELECT 'packages', CAST(id AS VARCHAR), 'delete' FROM v_packages WHERE project_id IN (SELECT project_id FROM pid)
UNION ALL SELECT 'settings', CAST(id AS VARCHAR), 'left_behind' FROM v_settings WHERE spider_id IN (SELECT id FROM sp)
UNION ALL SELECT 'figures', CAST(id AS VARCHAR), 'left_behind' FROM v_figures WHERE spider_id IN (SELECT id FROM sp)
UNION ALL SELECT 'webhook_jobs', CAST(id AS VARCHAR), 'left_behind' FROM v_webhook_jobs WHERE spider_id IN (SELECT id FROM sp)
UNION ALL SELECT 'projects', CAST(project_id AS VARCHAR), 'delete' FROM pid
""")
def q_j8(spark, sf):
    t = _t(spark, sf)
    pids = t.projects.where(F.col("owner_id") == 3).select(F.col("id").alias("project_id"))
    return J.project_delete_set(pids, {
        "spiders": t.spiders, "queue": t.queue, "parameters": t.parameters, "triggers": t.triggers,
        "history": t.history, "packages": t.packages, "settings": t.settings, "figures": t.figures,
        "webhook_jobs": t.webhook_jobs})


@register("J9_new_spiders", """
SELECT DISTINCT project_id, name FROM (
  SELECT project_id, unnest(list_filter(string_split(spider_list, ','), lambda x: x <> '')) AS name FROM v_packages) n
WHERE NOT EXISTS (SELECT 1 FROM v_spiders s WHERE s.project_id = n.project_id AND s.name = n.name)
""")
def q_j9(spark, sf):
    t = _t(spark, sf)
    return J.new_spiders(t.packages, t.spiders)


@register("J10_new_triggers", f"""
WITH res AS (
  SELECT r.req_id, s.spider_id, r.cron,
         CASE WHEN p.id IS NULL THEN 'project not found' WHEN s.spider_id IS NULL THEN 'spider not found' END AS reason
  FROM v_requests r
  LEFT JOIN (SELECT name, min(id) AS id FROM v_projects GROUP BY name) p ON p.name = r.project_name
  LEFT JOIN (SELECT project_id, name, min(id) AS spider_id FROM v_spiders GROUP BY 1, 2) s
         ON s.project_id = p.id AND s.name = r.spider_name),
x AS (SELECT res.*, EXISTS (SELECT 1 FROM v_triggers t WHERE t.spider_id = res.spider_id
                                                        AND t.cron_pattern = res.cron) AS present,
             {_d_valid("string_split(res.cron, ' ')")} AS valid FROM res),
first AS (SELECT spider_id, cron, min(req_id) AS first_req FROM x
          WHERE valid AND NOT present AND spider_id IS NOT NULL GROUP BY 1, 2)
SELECT x.req_id, x.spider_id, x.cron,
       CASE WHEN x.spider_id IS NULL THEN x.reason
            WHEN x.present OR x.req_id > f.first_req THEN 'duplicate'
            WHEN x.valid THEN 'accepted' ELSE 'invalid' END AS outcome
FROM x LEFT JOIN first f ON f.spider_id = x.spider_id AND f.cron = x.cron
""")
def q_j10(spark, sf):
    t = _t(spark, sf)
    res = resolve_spiders(t.requests, t.projects, t.spiders, by="name").select("req_id", "spider_id", "reason")
    req = res.join(t.requests.select("req_id", "cron"), "req_id")
    return J.new_triggers(req, t.triggers)


def _kv_sorted(m):
    return F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


@register("J11_job_payload", """
WITH req AS (SELECT spider_id, list_filter(string_split(arg_min(value, id), ';'), lambda x: x <> '') AS r
             FROM v_settings WHERE setting_key = 'extra_requirements' GROUP BY 1),
pm AS (SELECT spider_id, map_from_entries(list((parameter_key, value))) AS params FROM
         (SELECT spider_id, parameter_key, arg_min(value, id) AS value FROM v_parameters GROUP BY 1, 2) GROUP BY 1),
fg AS (SELECT spider_id, arg_min(text, id) AS text FROM v_figures GROUP BY 1),
fj AS (SELECT spider_id,
              CASE WHEN json_valid(text) THEN json_extract_string(text, '$.project_name') END AS f_project,
              CASE WHEN json_valid(text) THEN json_extract_string(text, '$.extra_requirements') END AS f_req,
              CASE WHEN json_valid(text) THEN json_extract_string(text, '$.output') END AS f_output,
              CASE WHEN json_valid(text) AND json_extract(text, '$.settings') IS NOT NULL
                        AND json_extract(text, '$.settings')::VARCHAR <> '{}'
                   THEN CAST(json_extract(text, '$.settings') AS MAP(VARCHAR, VARCHAR))
                   WHEN json_valid(text) AND json_extract(text, '$.spider_parameters') IS NOT NULL
                   THEN CAST(json_extract(text, '$.spider_parameters') AS MAP(VARCHAR, VARCHAR)) END AS f_params
       FROM fg),
j AS (SELECT q.*, p.version, coalesce(req.r, CAST([] AS VARCHAR[])) AS extra_requirements, pm.params, fj.*,
             CASE WHEN q.settings IS NOT NULL
                  THEN CAST(json_extract(q.settings, '$.spider_parameters') AS MAP(VARCHAR, VARCHAR)) END AS job_params
      FROM v_queue q JOIN v_spiders s ON s.id = q.spider_id JOIN v_projects p ON p.id = s.project_id
      LEFT JOIN req ON req.spider_id = q.spider_id LEFT JOIN pm ON pm.spider_id = q.spider_id
      LEFT JOIN fj ON fj.spider_id = q.spider_id)
SELECT id AS task_id, j.spider_id, spider_name, project_name, version, extra_requirements,
       list_sort(list_transform(map_entries(map_concat(coalesce(params, MAP {}), coalesce(job_params, MAP {}))),
                                lambda e: e.key || '=' || e.value)) AS spider_parameters,
       spider_name AS figure_spider, f_project AS figure_project,
       CASE WHEN f_req LIKE '[%' THEN CAST(CAST(f_req AS JSON) AS VARCHAR[])
            ELSE list_filter(string_split(coalesce(f_req, ''), ';'), lambda x: x <> '') END AS figure_requirements,
       list_sort(list_transform(map_entries(map_concat(coalesce(f_params, MAP {}), coalesce(params, MAP {}))),
                                lambda e: e.key || '=' || e.value)) AS figure_parameters,
       f_output AS figure_output
FROM j
""")
def q_j11(spark, sf):
    t = _t(spark, sf)
    p = J.job_payload(t.queue, t.spiders, t.projects, t.settings, t.parameters, t.figures)
    return p.select("task_id", "spider_id", "spider_name", "project_name", "version", "extra_requirements",
                    _kv_sorted(F.col("spider_parameters")).alias("spider_parameters"),
                    F.col("figure.spider").alias("figure_spider"),
                    F.col("figure.project_name").alias("figure_project"),
                    F.col("figure.extra_requirements").alias("figure_requirements"),
                    _kv_sorted(F.col("figure.spider_parameters")).alias("figure_parameters"),
                    F.col("figure.output").alias("figure_output"))


@register("J12_spider_jobs_with_webhook", """
SELECT h.id AS job_id, h.spider_id, h.status, w.id AS webhook_id, w.status AS webhook_status,
       js.name AS webhook_status_name
FROM v_history h LEFT JOIN v_webhook_jobs w ON w.job_id = h.id LEFT JOIN v_job_status js ON js.id = w.status
""")
def q_j12(spark, sf):
    t = _t(spark, sf)
    return J.spider_jobs_with_webhook(t.history, t.webhook_jobs, job_status(spark))


@register("F11_run_figure", """
WITH pm AS (SELECT spider_id, map_from_entries(list((parameter_key, value))) AS params FROM
         (SELECT spider_id, parameter_key, arg_min(value, id) AS value FROM v_parameters GROUP BY 1, 2) GROUP BY 1),
fg AS (SELECT spider_id, arg_min(text, id) AS text FROM v_figures GROUP BY 1),
fj AS (SELECT spider_id, CASE WHEN json_valid(text) THEN text ELSE '{}' END AS j FROM fg),
p AS (SELECT spider_id, j, CASE WHEN coalesce(CAST(json_extract(j, '$.settings') AS VARCHAR), '{}') <> '{}'
                                THEN CAST(json_extract(j, '$.settings') AS MAP(VARCHAR, VARCHAR))
                                WHEN json_extract(j, '$.spider_parameters') IS NOT NULL
                                THEN CAST(json_extract(j, '$.spider_parameters') AS MAP(VARCHAR, VARCHAR)) END AS own FROM fj)
SELECT p.spider_id, s.name AS spider, json_extract_string(j, '$.project_name') AS project_name,
       CASE WHEN json_type(j, '$.extra_requirements') = 'ARRAY' THEN CAST(json_extract(j, '$.extra_requirements') AS VARCHAR[])
            ELSE list_filter(string_split(coalesce(json_extract_string(j, '$.extra_requirements'), ''), ';'), lambda x: x <> '')
       END AS extra_requirements,
       list_sort(list_transform(map_entries(map_concat(coalesce(own, MAP {}), coalesce(params, MAP {}))),
                                lambda e: e.key || '=' || e.value)) AS spider_parameters,
       coalesce(CAST(json_extract(j, '$.plugin_settings') AS VARCHAR), '{}') AS plugin_settings,
       coalesce(CAST(json_extract(j, '$.plugins') AS VARCHAR), '[]') AS plugins,
       json_extract_string(j, '$.package') AS package, json_extract_string(j, '$.output') AS output
FROM p JOIN v_spiders s ON s.id = p.spider_id LEFT JOIN pm ON pm.spider_id = p.spider_id
""")
def q_f11(spark, sf):
    t = _t(spark, sf)
    f = F.col("figure")
    return J.spider_figures(t.spiders, t.parameters, t.figures).select(
        "spider_id", f["spider"].alias("spider"), f["project_name"].alias("project_name"), f["extra_requirements"].alias("extra_requirements"),
        _kv_sorted(f["spider_parameters"]).alias("spider_parameters"), f["plugin_settings"].alias("plugin_settings"),
        f["plugins"].alias("plugins"), f["package"].alias("package"), f["output"].alias("output"))
