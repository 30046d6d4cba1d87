"""Registered queries: lookups (P), ranking (T), aggregates (A), board."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlgrid.operators import aggregates as A
from crawlgrid.operators import history as T
from crawlgrid.operators import lookup as P
from crawlgrid.operators import board
from crawlgrid.plans import catalog_tables as C
from crawlgrid.plans.registry import register
from crawlgrid.session import scratch_dir
from crawlgrid.sources.catalog import SCHEMAS, job_status, read_catalog, write_catalog
from crawlgrid.sources.adapters import ANCHOR, DriverTables


def _t(spark, sf):
    return DriverTables(spark, sf)


# ---------------------------------------------------------------- T3 (flagship)
@register("T3_last_run_per_spider", """
WITH last AS (
  SELECT spider_id, start_time, status, items_count FROM (
    SELECT *, row_number() OVER (PARTITION BY spider_id ORDER BY start_time DESC NULLS LAST, id DESC) AS rn
    FROM v_history WHERE spider_id IS NOT NULL) WHERE rn = 1),
trig AS (SELECT spider_id, count(*) AS n FROM v_triggers GROUP BY spider_id)
SELECT p.id AS project_id, p.name AS project_name, s.id AS spider_id, s.name AS spider_name,
       l.start_time AS last_start_time, upper(js.name) AS last_status,
       CASE WHEN l.spider_id IS NULL THEN NULL WHEN coalesce(l.items_count, 0) = 0 THEN ''
            ELSE CAST(l.items_count AS VARCHAR) END AS last_items,
       CASE WHEN s.id IS NULL THEN NULL ELSE coalesce(t.n, 0) END AS trigger_count
FROM v_projects p LEFT JOIN v_spiders s ON s.project_id = p.id
LEFT JOIN last l ON l.spider_id = s.id
LEFT JOIN trig t ON t.spider_id = s.id
LEFT JOIN v_job_status js ON js.id = l.status
""")
def q_t3(spark, sf):
    t = _t(spark, sf)
    return T.last_run_per_spider(t.projects, t.spiders, t.history, job_status(spark), t.triggers)


# ---------------------------------------------------------------- P
@register("P1_projects_of", "SELECT * FROM v_projects WHERE owner_id = 2")
def q_p1(spark, sf):
    return P.projects_of(_t(spark, sf).projects, 2)


@register("P2_resolve_spiders_by_name", """
SELECT r.req_id, p.id AS project_id, s.spider_id,
       CASE WHEN p.id IS NULL THEN 'project not found'
            WHEN s.spider_id IS NULL THEN 'spider not found' END AS reason
FROM v_requests r
LEFT JOIN (SELECT name, min(id) AS id FROM v_projects GROUP BY name) p ON p.name = r.project_name
LEFT JOIN (SELECT project_id, name, min(id) AS spider_id FROM v_spiders GROUP BY 1, 2) s
       ON s.project_id = p.id AND s.name = r.spider_name
""")
def q_p2(spark, sf):
    t = _t(spark, sf)
    return P.resolve_spiders(t.requests, t.projects, t.spiders, by="name")


@register("P2_resolve_spiders_by_id", """
SELECT r.req_id, p.id AS project_id, s.spider_id,
       CASE WHEN p.id IS NULL THEN 'project not found'
            WHEN s.spider_id IS NULL THEN 'spider not found' END AS reason
FROM v_requests r
LEFT JOIN v_projects p ON p.id = r.project_id AND p.owner_id = r.owner_id
LEFT JOIN (SELECT project_id, name, min(id) AS spider_id FROM v_spiders GROUP BY 1, 2) s
       ON s.project_id = p.id AND s.name = r.spider_name
""")
def q_p2b(spark, sf):
    t = _t(spark, sf)
    return P.resolve_spiders(t.requests, t.projects, t.spiders, by="id")


@register("P3_visible_nodes",
          "SELECT * FROM v_nodes WHERE node_key_id IS NOT NULL OR is_deleted IS NOT DISTINCT FROM FALSE")
def q_p3(spark, sf):
    return P.visible_nodes(_t(spark, sf).nodes)


@register("P4_pending_jobs", "SELECT * FROM v_queue WHERE status = 0")
def q_p4(spark, sf):
    return P.jobs_by_status(_t(spark, sf).queue, 0)


@register("P4_running_jobs", "SELECT * FROM v_queue WHERE status = 1")
def q_p4b(spark, sf):
    return P.jobs_by_status(_t(spark, sf).queue, 1)


@register("P5_completable", """
SELECT c.*, CASE c.status WHEN 'success' THEN 2 WHEN 'fail' THEN 3 END AS status_code,
       r.reason IS NULL AS accepted, r.reason
FROM v_completions c
LEFT JOIN (SELECT id, node_id FROM v_queue WHERE status IN (1, 5)) q
       ON q.id = c.job_id AND (c.node_id IS NULL OR c.node_id = q.node_id)
CROSS JOIN LATERAL (SELECT CASE WHEN c.status NOT IN ('success', 'fail') THEN 'invalid status'
                                WHEN q.id IS NULL THEN 'job not found' END AS reason) r
""")
def q_p5(spark, sf):
    t = _t(spark, sf)
    return P.completable(t.completions, t.queue)


@register("P6_job_detail", """
SELECT h.id AS job_id, p.name AS project, s.name AS spider, h.fire_time, h.start_time,
       h.complete_time, h.status, js.name AS status_name, h.items_count
FROM v_history h JOIN v_spiders s ON s.id = h.spider_id JOIN v_projects p ON p.id = s.project_id
LEFT JOIN v_job_status js ON js.id = h.status
""")
def q_p6(spark, sf):
    t = _t(spark, sf)
    return P.job_detail(t.history, t.spiders, t.projects, job_status(spark))


@register("P7_job_status_of", """
WITH ids AS (SELECT DISTINCT job_id FROM v_completions)
SELECT ids.job_id, coalesce(q.status, h.status) AS status,
       CASE WHEN q.id IS NOT NULL THEN 'queue' WHEN h.id IS NOT NULL THEN 'history' END AS source,
       js.name AS status_name
FROM ids LEFT JOIN v_queue q ON q.id = ids.job_id LEFT JOIN v_history h ON h.id = ids.job_id
LEFT JOIN v_job_status js ON js.id = coalesce(q.status, h.status)
""")
def q_p7(spark, sf):
    t = _t(spark, sf)
    ids = t.completions.select("job_id").distinct()
    return P.job_status_of(ids, t.queue, t.history, job_status(spark))


@register("P8_node_view", """
SELECT 'nodes/' || id AS name, id, name AS display_name, coalesce(tags, CAST([] AS VARCHAR[])) AS tags,
       isalive > 0 AS is_online, client_ip FROM v_nodes
""")
def q_p8(spark, sf):
    return P.node_view(_t(spark, sf).nodes)


@register("P9_setting_violations", """
SELECT s.*, CASE WHEN s.setting_key NOT IN ('concurrency', 'timeout', 'tag', 'extra_requirements',
                                            'webhook_payload', 'webhook_batch_size') THEN 'unknown key'
                 ELSE 'bad value' END AS reason
FROM v_settings s
WHERE s.setting_key NOT IN ('concurrency', 'timeout', 'tag', 'extra_requirements', 'webhook_payload',
                            'webhook_batch_size')
   OR (s.setting_key IN ('concurrency', 'timeout', 'webhook_batch_size')
       AND NOT coalesce(regexp_full_match(s.value, '\\d+'), FALSE))
""")
def q_p9(spark, sf):
    return P.setting_violations(_t(spark, sf).settings)


# ---------------------------------------------------------------- T
_PURGE_RANK = """ranked AS (SELECT *, row_number() OVER (PARTITION BY spider_id
                   ORDER BY complete_time DESC NULLS LAST, id) AS rank FROM v_history)"""


@register("T1_history_to_purge", f"WITH {_PURGE_RANK} SELECT * EXCLUDE (rank) FROM ranked WHERE rank > 2")
def q_t1(spark, sf):
    return T.history_to_purge(_t(spark, sf).history, keep=2)


@register("T2_history_after_purge",
          f"WITH {_PURGE_RANK} SELECT * EXCLUDE (rank) FROM ranked WHERE rank <= 2")
def q_t2(spark, sf):
    return T.history_after_purge(_t(spark, sf).history, keep=2)


@register("T4_recent_finished",
          "SELECT * FROM v_history ORDER BY complete_time DESC NULLS LAST, id LIMIT 100")
def q_t4(spark, sf):
    return T.recent_finished(_t(spark, sf).history, 100)


@register("T5_recent_jobs_per_spider", """
SELECT spider_id, job_id, section, status, rank FROM (
  SELECT spider_id, id AS job_id, 'finished' AS section, status,
         row_number() OVER (PARTITION BY spider_id ORDER BY start_time DESC NULLS LAST, id DESC) AS rank
  FROM v_history WHERE spider_id IS NOT NULL) WHERE rank <= 2
UNION ALL
SELECT spider_id, id, 'queue', status,
       row_number() OVER (PARTITION BY spider_id ORDER BY update_time DESC NULLS LAST, id DESC)
FROM v_queue
""")
def q_t5(spark, sf):
    t = _t(spark, sf)
    return T.recent_jobs_per_spider(t.history, t.queue, k=2)


@register("T6_latest_package", """
SELECT project_id, version, id AS package_id, egg_version, file_path FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY version DESC) AS rn FROM v_packages)
WHERE rn = 1
""")
def q_t6(spark, sf):
    return T.latest_package(_t(spark, sf).packages)


@register("T7_next_webhook_job", "SELECT * FROM v_webhook_jobs WHERE status = 0 ORDER BY id LIMIT 1")
def q_t7(spark, sf):
    return T.next_webhook_job(_t(spark, sf).webhook_jobs)


@register("T8_node_key_rotation", f"""
WITH cand AS (SELECT * FROM v_node_keys WHERE used_node_id IS NULL AND is_deleted = FALSE),
ff AS (SELECT min(id) AS first_fresh FROM cand
       WHERE create_at >= TIMESTAMP '{ANCHOR}' - INTERVAL 3600 SECOND)
SELECT id AS key_id, CASE WHEN id = first_fresh THEN 'use' ELSE 'delete' END AS action
FROM cand, ff WHERE first_fresh IS NULL OR id <= first_fresh
UNION ALL
SELECT NULL, 'create' FROM ff WHERE first_fresh IS NULL
""")
def q_t8(spark, sf):
    return T.node_key_rotation(_t(spark, sf).node_keys, ANCHOR)


@register("T9_job_order_listing", """
SELECT spider_id, 'setting' AS kind, setting_key AS key, value,
       row_number() OVER (PARTITION BY spider_id ORDER BY setting_key, id) AS pos FROM v_settings
UNION ALL
SELECT spider_id, 'parameter', parameter_key, value,
       row_number() OVER (PARTITION BY spider_id ORDER BY parameter_key, id) FROM v_parameters
UNION ALL
SELECT spider_id, 'trigger', CAST(id AS VARCHAR), cron_pattern,
       row_number() OVER (PARTITION BY spider_id ORDER BY id) FROM v_triggers
""")
def q_t9(spark, sf):
    t = _t(spark, sf)
    return T.job_order_listing(t.settings, t.parameters, t.triggers)


# ---------------------------------------------------------------- A
@register("A1_running_per_spider",
          "SELECT spider_id, count(*) AS running FROM v_queue WHERE status = 1 GROUP BY spider_id")
def q_a1(spark, sf):
    return A.running_per_spider(_t(spark, sf).queue)


@register("A2_first_pending_per_spider",
          "SELECT spider_id, min(fire_time) AS fire_time FROM v_queue WHERE status = 0 GROUP BY spider_id")
def q_a2(spark, sf):
    return A.first_pending_per_spider(_t(spark, sf).queue)


@register("A3_spiders_with_history", "SELECT DISTINCT spider_id FROM v_history")
def q_a3(spark, sf):
    return A.spiders_with_history(_t(spark, sf).history)


@register("A4_dashboard_counts", """
SELECT (SELECT count(*) FROM v_users) AS user_count,
       count(*) FILTER (WHERE isalive = 1) AS active_node_count, count(*) AS all_node_count
FROM v_nodes
""")
def q_a4(spark, sf):
    t = _t(spark, sf)
    return A.dashboard_counts(t.users, t.nodes)


@register("A5_spider_counts", """
SELECT s.id AS spider_id, coalesce(h.n, 0) AS jobs_count, coalesce(t.n, 0) AS triggers_count
FROM v_spiders s
LEFT JOIN (SELECT spider_id, count(*) AS n FROM v_history GROUP BY 1) h ON h.spider_id = s.id
LEFT JOIN (SELECT spider_id, count(*) AS n FROM v_triggers GROUP BY 1) t ON t.spider_id = s.id
""")
def q_a5(spark, sf):
    t = _t(spark, sf)
    return A.spider_counts(t.spiders, t.history, t.triggers)


@register("A6_key_quota",
          "SELECT user_id, count(*) AS n, count(*) < 10 AS allowed FROM v_user_keys GROUP BY user_id")
def q_a6(spark, sf):
    return A.key_quota(_t(spark, sf).user_keys, 10)


@register("A7_effective_settings", """
WITH d AS (SELECT spider_id, setting_key, arg_min(value, id) AS value FROM v_settings GROUP BY 1, 2),
keys AS (SELECT s.id AS spider_id, k.setting_key, k.dflt
         FROM v_spiders s, (VALUES ('concurrency', '1'), ('timeout', '3600'), ('tag', '')) k(setting_key, dflt)),
merged AS (
  SELECT coalesce(d.spider_id, k.spider_id) AS spider_id, coalesce(d.setting_key, k.setting_key) AS setting_key,
         CASE WHEN d.spider_id IS NULL THEN k.dflt
              WHEN d.setting_key = 'tag' AND d.value IS NULL THEN ''
              ELSE d.value END AS value
  FROM d FULL OUTER JOIN keys k ON d.spider_id = k.spider_id AND d.setting_key = k.setting_key
  WHERE k.spider_id IS NOT NULL OR d.spider_id IN (SELECT id FROM v_spiders))
SELECT * FROM merged
""")
def q_a7(spark, sf):
    t = _t(spark, sf)
    m = A.effective_settings(t.settings, t.spiders)
    return m.select("spider_id", F.explode("settings").alias("setting_key", "value"))


@register("A8_next_package_version", """
SELECT p.id AS project_id, coalesce(m.mx, 0) + 1 AS next_version
FROM v_projects p LEFT JOIN (SELECT project_id, max(version) AS mx FROM v_packages GROUP BY 1) m
ON m.project_id = p.id
""")
def q_a8(spark, sf):
    t = _t(spark, sf)
    return A.next_package_version(t.projects, t.packages)


# ---------------------------------------------------------------- I8, I9, U1
@register("I8_job_runtimes", """
SELECT id AS job_id, 'queue' AS source, status,
       CASE WHEN start_time IS NULL OR update_time IS NULL THEN NULL
            ELSE date_diff('second', start_time, update_time) END AS runtime_s
FROM v_queue WHERE status IN (1, 5)
UNION ALL
SELECT id, 'history', status,
       CASE WHEN start_time IS NULL OR complete_time IS NULL THEN NULL
            ELSE date_diff('second', start_time, complete_time) END
FROM v_history
""")
def q_i8(spark, sf):
    t = _t(spark, sf)
    return board.job_runtimes(t.queue, t.history)


@register("I9_jobs_board", """
SELECT * FROM (
  SELECT 'pending' AS section, id AS job_id, spider_id, project_name, spider_name, status, fire_time,
         start_time, update_time AS end_time, NULL::BIGINT AS runtime_s FROM v_queue WHERE status = 0
  UNION ALL
  SELECT 'running', id, spider_id, project_name, spider_name, status, fire_time, start_time, update_time,
         date_diff('second', start_time, update_time) FROM v_queue WHERE status = 1
  UNION ALL
  SELECT * FROM (SELECT 'finished', id, spider_id, project_name, spider_name, status, fire_time, start_time,
         complete_time, date_diff('second', start_time, complete_time) FROM v_history
         ORDER BY complete_time DESC NULLS LAST, id LIMIT 100))
""")
def q_i9(spark, sf):
    t = _t(spark, sf)
    return board.jobs_board(t.queue, t.history)


# ---------------------------------------------------------------- S1, F3
# columns of the views that fill catalog tables
_VIEW_COLUMNS = {
    "user": ["id", "username", "is_admin", "is_active"], "user_keys": ["id", "user_id", "app_key", "app_secret", "enabled"],
    "projects": ["id", "name", "version", "storage_version", "owner_id"], "spiders": ["id", "project_id", "name"],
    "spider_settings": ["id", "spider_id", "setting_key", "value"], "spider_parameters": ["id", "spider_id", "parameter_key", "value"],
    "triggers": ["id", "spider_id", "cron_pattern"],
    "spider_execution_queue": ["id", "spider_id", "slot", "project_name", "spider_name", "fire_time", "start_time", "node_id", "status",
                               "update_time", "pid", "tag", "settings"],
    "job_history": ["id", "spider_id", "project_name", "spider_name", "fire_time", "start_time", "complete_time", "status", "items_count"],
    "packages": ["id", "project_id", "spider_list", "version", "egg_version", "checksum", "file_path", "create_date"],
    "webhook_jobs": ["id", "job_id", "spider_id", "payload_url", "status", "log"],
    "nodes": ["id", "name", "client_ip", "create_time", "last_heartbeat", "isalive", "is_deleted", "node_key_id"],
    "node_keys": ["id", "key", "secret_key", "is_deleted", "used_node_id", "create_at"],
    "nodesessions": ["id", "node_id", "create_at", "last_heartbeat"], "spider_figure": ["id", "spider_id", "text"],
}


@register("S1_read_catalog", " UNION ALL ".join(C.digest_sql(n, C.columns(_VIEW_COLUMNS, n)) for n in SCHEMAS))
def q_s1(spark, sf):
    root = scratch_dir(spark, "catalog")
    write_catalog(C.tables(_t(spark, sf)), root)
    parts = [C.digest(df, n, C.columns(_VIEW_COLUMNS, n)) for n, df in read_catalog(spark, root).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("F3_tag_match", """
SELECT q.id AS job_id, q.node_id,
       CASE WHEN len(st) = 0 AND len(nt) = 0 THEN TRUE WHEN len(st) = 0 OR len(nt) = 0 THEN FALSE
            ELSE list_has_all(nt, st) END AS tags_match
FROM (SELECT id, node_id, list_filter(string_split(coalesce(tag, ''), ','), lambda x: x <> '') AS st
      FROM v_queue WHERE status = 1) q
JOIN (SELECT id, coalesce(tags, CAST([] AS VARCHAR[])) AS nt FROM v_nodes) n ON n.id = q.node_id
""")
def q_f3(spark, sf):
    from crawlgrid.functions.tags import tag_match
    from crawlgrid.functions.text import split_clean
    t = _t(spark, sf)
    q = t.queue.where(F.col("status") == 1).select(F.col("id").alias("job_id"), "node_id",
                                                     split_clean("tag", ",").alias("_st"))
    n = t.nodes.select(F.col("id").alias("_nid"), F.col("tags").alias("_nt"))
    return (q.join(n, q.node_id == n._nid)
            .select("job_id", "node_id", tag_match(F.col("_st"), F.col("_nt")).alias("tags_match")))
