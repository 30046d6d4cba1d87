"""Registered queries for the lifecycle operators L1-L15."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlgrid.operators import dispatch as D
from crawlgrid.operators import lifecycle as L
from crawlgrid.operators.logs import log_facts
from crawlgrid.operators.lookup import completable, resolve_spiders
from crawlgrid.plans.q_dispatch import _J1, _J2, _MATCH, _NTAGS, _STAGS
from crawlgrid.plans.registry import register
from crawlgrid.sources.adapters import ANCHOR, DriverTables

A = f"TIMESTAMP '{ANCHOR}'"
SESSION_AS_OF = "2024-01-15 12:00:00"


def _t(spark, sf):
    return DriverTables(spark, sf)


# ---------------------------------------------------------------- L1
def _requests(t):
    r = resolve_spiders(t.requests, t.projects, t.spiders, by="name").where(F.col("spider_id").isNotNull())
    return r.select(F.concat(F.lit("req-"), F.col("req_id").cast("string")).alias("req_key"), "spider_id",
                    F.when(F.col("req_id") % 3 == 0,
                           F.concat(F.lit('{"spider_parameters": {"k": "'), F.col("req_id").cast("string"),
                                    F.lit('"}}'))).alias("settings"))


@register("L1_enqueue", f"""
WITH res AS (
  SELECT r.req_id, s.spider_id FROM v_requests r
  JOIN (SELECT name, min(id) AS id FROM v_projects GROUP BY name) p ON p.name = r.project_name
  JOIN (SELECT project_id, name, min(id) AS spider_id FROM v_spiders GROUP BY 1, 2) s
    ON s.project_id = p.id AND s.name = r.spider_name),
tag AS (SELECT spider_id, arg_min(value, id) AS tag FROM v_settings WHERE setting_key = 'tag' GROUP BY 1)
SELECT md5('req-' || res.req_id) AS id, res.spider_id, 1 AS slot, p.name AS project_name, s.name AS spider_name,
       {A} AS fire_time, CAST(NULL AS TIMESTAMP) AS start_time, CAST(NULL AS BIGINT) AS node_id, 0 AS status,
       {A} AS update_time, CAST(NULL AS INTEGER) AS pid, tag.tag,
       CASE WHEN res.req_id % 3 = 0 THEN '{{"spider_parameters": {{"k": "' || res.req_id || '"}}}}' END AS settings
FROM res JOIN v_spiders s ON s.id = res.spider_id JOIN v_projects p ON p.id = s.project_id
LEFT JOIN tag ON tag.spider_id = res.spider_id
""")
def q_l1(spark, sf):
    t = _t(spark, sf)
    return L.enqueue(_requests(t), t.spiders, t.projects, t.settings, ANCHOR)


# ---------------------------------------------------------------- L2
_J4_ASSIGN = f"""assign AS (
  WITH {_J1}, {_J2}, {_STAGS}, {_NTAGS},
  cand AS (SELECT j2.id, j2.fire_time, coalesce(t.st, CAST([] AS VARCHAR[])) AS st
           FROM j2 LEFT JOIN stags t ON t.spider_id = j2.spider_id),
  best AS (SELECT n.id AS node_id, c.id AS job_id,
                  row_number() OVER (PARTITION BY n.id ORDER BY c.fire_time, c.id) AS rn
           FROM ntags n JOIN cand c ON {_MATCH})
  SELECT b.job_id, min(b.node_id) AS node_id FROM (SELECT DISTINCT node_id FROM v_beats) a
  JOIN best b ON b.node_id = a.node_id AND b.rn = 1 GROUP BY b.job_id)"""


@register("L2_claim", f"""
WITH {_J4_ASSIGN}
SELECT q.* REPLACE (CASE WHEN a.job_id IS NOT NULL THEN 1 ELSE q.status END AS status,
                    CASE WHEN a.job_id IS NOT NULL THEN {A} ELSE q.start_time END AS start_time,
                    CASE WHEN a.job_id IS NOT NULL THEN {A} ELSE q.update_time END AS update_time,
                    CASE WHEN a.job_id IS NOT NULL THEN a.node_id ELSE q.node_id END AS node_id)
FROM v_queue q LEFT JOIN assign a ON a.job_id = q.id
""")
def q_l2(spark, sf):
    t = _t(spark, sf)
    nxt = D.next_job_per_node(t.queue, t.settings, t.nodes, t.beats).where("has_job")
    return L.claim(t.queue, nxt.select("job_id", "node_id"), ANCHOR)


# ---------------------------------------------------------------- L3
@register("L3_mark_started", f"""
WITH s AS (SELECT job_id, arg_min(node_id * 1000 + minute(ts), ts) AS pid FROM v_reports GROUP BY 1)
SELECT q.* REPLACE (CASE WHEN s.job_id IS NOT NULL THEN coalesce(q.start_time, {A}) ELSE q.start_time END AS start_time,
                    CASE WHEN s.job_id IS NOT NULL THEN coalesce(q.pid, CAST(s.pid AS INTEGER)) ELSE q.pid END AS pid,
                    CASE WHEN s.job_id IS NOT NULL THEN {A} ELSE q.update_time END AS update_time)
FROM v_queue q LEFT JOIN s ON s.job_id = q.id
""")
def q_l3(spark, sf):
    t = _t(spark, sf)
    starts = t.reports.select("job_id", "ts", (F.col("node_id") * 1000 + F.minute("ts")).alias("pid"))
    return L.mark_started(t.queue, starts, ANCHOR)


# ---------------------------------------------------------------- L4
_CANCEL_IDS = "ids AS (SELECT DISTINCT job_id FROM v_completions WHERE status = 'bogus')"


def _cancel(spark, sf):
    t = _t(spark, sf)
    ids = t.completions.where(F.col("status") == "bogus").select("job_id")
    return L.cancel(t.queue, ids, ANCHOR)


@register("L4_cancel_history", f"""
WITH {_CANCEL_IDS}
SELECT id, spider_id, project_name, spider_name, fire_time, start_time, {A} AS complete_time, 6 AS status,
       CAST(NULL AS INTEGER) AS items_count
FROM v_queue WHERE status IN (0, 1) AND id IN (SELECT job_id FROM ids)
""")
def q_l4h(spark, sf):
    return _cancel(spark, sf)["history"]


@register("L4_cancel_errors", f"""
WITH {_CANCEL_IDS}
SELECT * FROM (SELECT ids.job_id, CASE WHEN q.id IS NULL THEN 'JobNotFound'
                                       WHEN q.status NOT IN (0, 1) THEN 'InvalidJobStatus' END AS error
               FROM ids LEFT JOIN v_queue q ON q.id = ids.job_id) WHERE error IS NOT NULL
""")
def q_l4e(spark, sf):
    return _cancel(spark, sf)["errors"]


@register("L4_cancel_queue", f"""
WITH {_CANCEL_IDS}
SELECT * FROM v_queue WHERE NOT (status IN (0, 1) AND id IN (SELECT job_id FROM ids))
""")
def q_l4q(spark, sf):
    return _cancel(spark, sf)["queue"]


# ---------------------------------------------------------------- L5
_FINISH = """acc AS (
  SELECT c.*, CASE c.status WHEN 'success' THEN 2 ELSE 3 END AS code FROM v_completions c
  JOIN (SELECT id, node_id FROM v_queue WHERE status IN (1, 5)) q
    ON q.id = c.job_id AND (c.node_id IS NULL OR c.node_id = q.node_id)
  WHERE c.status IN ('success', 'fail')),
first AS (SELECT job_id, code FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, completion_id) AS rn
                                    FROM acc) WHERE rn = 1),
facts AS (
  SELECT job_id,
    arg_min(TRY_CAST(regexp_extract(line, '''item_scraped_count'': (\\d+),', 1) AS BIGINT), line_no)
      FILTER (WHERE regexp_matches(line, '''item_scraped_count'': (\\d+),')) AS items_count,
    bool_or(regexp_matches(line, '''log_count/ERROR'': (\\d+),')) AS has_error,
    bool_or(regexp_matches(line, '''log_count/WARNING'': (\\d+),')) AS has_warning
  FROM v_logs GROUP BY job_id)"""


def _finish(spark, sf):
    t = _t(spark, sf)
    acc = completable(t.completions, t.queue).where("accepted")
    return L.finish(t.queue, acc, log_facts(t.logs), ANCHOR)


@register("L5_finish_history", f"""
WITH {_FINISH}
SELECT q.id, q.spider_id, q.project_name, q.spider_name, q.fire_time, q.start_time, {A} AS complete_time,
       CASE WHEN first.code = 2 AND coalesce(f.has_error, FALSE) THEN 3
            WHEN first.code = 2 AND coalesce(f.has_warning, FALSE) THEN 4 ELSE first.code END AS status,
       CAST(f.items_count AS INTEGER) AS items_count
FROM v_queue q JOIN first ON first.job_id = q.id LEFT JOIN facts f ON f.job_id = q.id
""")
def q_l5h(spark, sf):
    return _finish(spark, sf)["history"]


@register("L5_finish_queue", f"WITH {_FINISH} SELECT * FROM v_queue WHERE id NOT IN (SELECT job_id FROM first)")
def q_l5q(spark, sf):
    return _finish(spark, sf)["queue"]


# ---------------------------------------------------------------- L6
@register("L6_move_completed_history", """
SELECT id, spider_id, project_name, spider_name, fire_time, start_time, update_time AS complete_time, status,
       CAST(NULL AS INTEGER) AS items_count FROM v_queue WHERE status IN (2, 3)
""")
def q_l6h(spark, sf):
    return L.move_completed(_t(spark, sf).queue)["history"]


@register("L6_move_completed_queue", "SELECT * FROM v_queue WHERE status NOT IN (2, 3)")
def q_l6q(spark, sf):
    return L.move_completed(_t(spark, sf).queue)["queue"]


# ---------------------------------------------------------------- L7
_SWEEP = f"""to_ AS (SELECT spider_id, TRY_CAST(trim(arg_min(value, id)) AS BIGINT) AS t FROM v_settings
                     WHERE setting_key = 'timeout' GROUP BY 1),
s1 AS (SELECT q.*, CASE WHEN q.status = 1 AND {A} > q.start_time + to_seconds(coalesce(to_.t, 3600)) THEN 'stop'
                        WHEN q.status = 1 AND {A} > q.update_time + INTERVAL 60 SECOND THEN 'requeue' END AS act
       FROM v_queue q LEFT JOIN to_ ON to_.spider_id = q.spider_id),
s2 AS (SELECT * REPLACE (CASE act WHEN 'stop' THEN 5 WHEN 'requeue' THEN 0 ELSE status END AS status,
                         CASE WHEN act IS NOT NULL THEN {A} ELSE update_time END AS update_time,
                         CASE WHEN act = 'requeue' THEN NULL ELSE pid END AS pid,
                         CASE WHEN act = 'requeue' THEN NULL ELSE node_id END AS node_id) FROM s1),
s3 AS (SELECT *, status = 5 AND coalesce(
          (((epoch_us({A}) - epoch_us(start_time)) // 1000000) % 86400 + 86400) % 86400 > 120, FALSE) AS kill
       FROM s2)"""


def _sweep(spark, sf):
    t = _t(spark, sf)
    return L.timeout_sweep(t.queue, t.settings, ANCHOR)


@register("L7_timeout_actions", f"""
WITH {_SWEEP}
SELECT id AS job_id, CASE WHEN kill THEN CASE WHEN act = 'stop' THEN 'stop_fail' ELSE 'fail' END ELSE act END AS action
FROM s3 WHERE act IS NOT NULL OR kill
""")
def q_l7a(spark, sf):
    return _sweep(spark, sf)["actions"]


@register("L7_timeout_history", f"""
WITH {_SWEEP}
SELECT id, spider_id, project_name, spider_name, fire_time, start_time, update_time AS complete_time, 3 AS status,
       CAST(NULL AS INTEGER) AS items_count FROM s3 WHERE kill
""")
def q_l7h(spark, sf):
    return _sweep(spark, sf)["history"]


@register("L7_timeout_queue", f"WITH {_SWEEP} SELECT * EXCLUDE (act, kill) FROM s3 WHERE NOT kill")
def q_l7q(spark, sf):
    return _sweep(spark, sf)["queue"]


# ---------------------------------------------------------------- L8, L9, L10
_EXPIRED = f"""expired AS (SELECT id AS node_id FROM v_nodes
                          WHERE isalive = 1 AND last_heartbeat < {A} - INTERVAL 60 SECOND)"""


@register("L8_requeue_from_nodes", f"""
WITH {_EXPIRED}
SELECT q.* EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 0 ELSE status END AS status,
                    CASE WHEN hit THEN {A} ELSE update_time END AS update_time,
                    CASE WHEN hit THEN NULL ELSE start_time END AS start_time,
                    CASE WHEN hit THEN NULL ELSE pid END AS pid,
                    CASE WHEN hit THEN NULL ELSE node_id END AS node_id)
FROM (SELECT *, status = 1 AND node_id IN (SELECT node_id FROM expired) AS hit FROM v_queue) q
""")
def q_l8(spark, sf):
    t = _t(spark, sf)
    sweep = L.node_sweep(t.nodes, ANCHOR)
    return L.requeue_from_nodes(t.queue, sweep["expired"], ANCHOR)


@register("L9_node_sweep", f"""
SELECT * EXCLUDE (exp) REPLACE (CASE WHEN exp THEN 0 ELSE isalive END AS isalive,
                  CASE WHEN exp AND coalesce(node_key_id, 0) = 0 THEN TRUE ELSE is_deleted END AS is_deleted)
FROM (SELECT *, coalesce(isalive = 1 AND last_heartbeat < {A} - INTERVAL 60 SECOND, FALSE) AS exp FROM v_nodes)
""")
def q_l9(spark, sf):
    return L.node_sweep(_t(spark, sf).nodes, ANCHOR)["nodes"]


@register("L10_session_sweep", f"""
SELECT * FROM v_sessions WHERE NOT (last_heartbeat < TIMESTAMP '{SESSION_AS_OF}' - INTERVAL 60 SECOND)
""")
def q_l10(spark, sf):
    return L.session_sweep(_t(spark, sf).sessions, SESSION_AS_OF)


# ---------------------------------------------------------------- L11-L13
# the sessions before the batch: each node's first one
@register("L11_login_decisions", """
WITH RECURSIVE st AS (SELECT node_id, min(create_at) AS c FROM v_sessions GROUP BY 1),
att AS (SELECT l.*, st.c FROM v_logins l JOIN v_nodes n ON n.id = l.node_id LEFT JOIN st ON st.node_id = l.node_id),
acc AS (SELECT node_id, min(ts) AS ts FROM att WHERE c IS NULL OR c <= ts - INTERVAL 60 SECOND GROUP BY 1
        UNION ALL
        SELECT a.node_id, min(x.ts) FROM acc a JOIN att x ON x.node_id = a.node_id AND x.ts >= a.ts + INTERVAL 60 SECOND
        GROUP BY a.node_id, a.ts),
ok AS (SELECT min(att.attempt_id) AS attempt_id, (min(att.c) IS NOT NULL OR acc.ts > (SELECT min(z.ts) FROM acc z WHERE z.node_id = acc.node_id)) AS again
       FROM acc JOIN att ON att.node_id = acc.node_id AND att.ts = acc.ts GROUP BY acc.node_id, acc.ts)
SELECT l.attempt_id, l.node_id,
       CASE WHEN l.node_id IS NULL THEN 'anonymous_disabled' WHEN n.id IS NULL THEN 'not_found'
            WHEN ok.attempt_id IS NULL THEN 'conflict' WHEN ok.again THEN 'replace' ELSE 'new_session' END AS decision
FROM v_logins l LEFT JOIN v_nodes n ON n.id = l.node_id LEFT JOIN ok ON ok.attempt_id = l.attempt_id
""")
def q_l11(spark, sf):
    t = _t(spark, sf)
    before = t.sessions.groupBy("node_id").agg(F.min("create_at").alias("create_at"))
    return L.login_decisions(t.logins, t.nodes, before, auth_enabled=True)


_SESSION_BEATS = """last AS (SELECT session_id, max(ts) AS last_beat FROM v_beats GROUP BY 1),
outcome AS (SELECT last.session_id, last.last_beat,
                   CASE WHEN s.id IS NULL THEN 'unknown session' WHEN n.id IS NULL THEN 'unknown node'
                        WHEN n.isalive = 0 AND coalesce(n.node_key_id, 0) = 0 THEN 'dead unregistered' END AS reason
            FROM last LEFT JOIN v_sessions s ON s.id = last.session_id LEFT JOIN v_nodes n ON n.id = s.node_id)"""


@register("L12_session_outcome", f"WITH {_SESSION_BEATS} SELECT session_id, last_beat, reason IS NULL AS accepted, reason FROM outcome")
def q_l12s(spark, sf):
    t = _t(spark, sf)
    return L.apply_session_heartbeats(t.nodes, t.sessions, t.beats)["outcome"]


@register("L12_session_heartbeats", f"""
WITH {_SESSION_BEATS}
SELECT s.* REPLACE (coalesce(o.last_beat, s.last_heartbeat) AS last_heartbeat)
FROM v_sessions s LEFT JOIN (SELECT * FROM outcome WHERE reason IS NULL) o ON o.session_id = s.id
""")
def q_l12t(spark, sf):
    t = _t(spark, sf)
    return L.apply_session_heartbeats(t.nodes, t.sessions, t.beats)["sessions"]


_BEATS = """last AS (SELECT node_id, max(ts) AS last_beat FROM v_beats GROUP BY 1),
outcome AS (SELECT last.node_id, last.last_beat,
                   CASE WHEN n.id IS NULL THEN 'unknown node'
                        WHEN n.isalive = 0 AND coalesce(n.node_key_id, 0) = 0 THEN 'dead unregistered' END AS reason
            FROM last LEFT JOIN v_nodes n ON n.id = last.node_id)"""


@register("L12_heartbeat_outcome", f"""
WITH {_BEATS} SELECT node_id, last_beat, reason IS NULL AS accepted, reason FROM outcome
""")
def q_l12(spark, sf):
    t = _t(spark, sf)
    return L.apply_heartbeats(t.nodes, t.beats)["outcome"]


@register("L12_heartbeat_nodes", f"""
WITH {_BEATS}
SELECT n.* REPLACE (coalesce(o.last_beat, n.last_heartbeat) AS last_heartbeat,
                    CASE WHEN o.node_id IS NOT NULL THEN 1 ELSE n.isalive END AS isalive)
FROM v_nodes n LEFT JOIN (SELECT * FROM outcome WHERE reason IS NULL) o ON o.node_id = n.id
""")
def q_l12n(spark, sf):
    t = _t(spark, sf)
    return L.apply_heartbeats(t.nodes, t.beats)["nodes"]


@register("L13_resolve_node_keys", """
WITH tokens AS (SELECT DISTINCT 'nk' || (event_id * 2) AS token FROM events)
SELECT t.token, CASE WHEN k.key IS NOT NULL AND k.used_node_id IS NOT NULL AND n.id IS NOT NULL
                          AND NOT coalesce(n.is_deleted, FALSE) THEN n.id END AS node_id,
       CASE WHEN k.key IS NULL THEN 'key not found' WHEN k.used_node_id IS NULL THEN 'unused'
            WHEN n.id IS NULL THEN 'node not found' WHEN coalesce(n.is_deleted, FALSE) THEN 'node deleted'
            ELSE 'ok' END AS outcome,
       k.key IS NOT NULL AND k.used_node_id IS NULL AS can_register
FROM tokens t LEFT JOIN v_node_keys k ON k.key = t.token LEFT JOIN v_nodes n ON n.id = k.used_node_id
""")
def q_l13(spark, sf):
    t = _t(spark, sf)
    tokens = t.raw("events").select(F.concat(F.lit("nk"), (F.col("event_id") * 2).cast("string")).alias("token")).distinct()
    return L.resolve_node_keys(tokens, t.node_keys, t.nodes)


# ---------------------------------------------------------------- L14
@register("L14_webhook_job_transitions", """
WITH lastnr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY webhook_job_id ORDER BY ts DESC, event_id DESC) AS rn
                               FROM v_webhook_events WHERE event <> 'restart') WHERE rn = 1),
rs AS (SELECT webhook_job_id, max(ts) AS rts FROM v_webhook_events WHERE event = 'restart' GROUP BY 1),
j AS (SELECT w.*, l.event AS ev, l.log AS elog, l.ts AS lts, rs.rts,
             CASE l.event WHEN 'start' THEN 1 WHEN 'finish' THEN 2 WHEN 'fail' THEN 3 ELSE w.status END AS after
      FROM v_webhook_jobs w LEFT JOIN lastnr l ON l.webhook_job_id = w.id LEFT JOIN rs ON rs.webhook_job_id = w.id)
SELECT id, job_id, spider_id, payload_url,
       CAST(CASE WHEN rts IS NOT NULL AND (lts IS NULL OR rts > lts) AND after = 1 THEN 0 ELSE after END AS INTEGER) AS status,
       CASE WHEN ev IN ('finish', 'fail') AND elog IS NOT NULL THEN elog ELSE log END AS log
FROM j
""")
def q_l14(spark, sf):
    t = _t(spark, sf)
    return L.webhook_job_transitions(t.webhook_jobs, t.webhook_events)


_HOOK_URL = """hook AS (SELECT * FROM (SELECT spider_id, arg_min(value, id) AS url FROM v_settings
      WHERE setting_key = 'webhook_payload' GROUP BY 1) WHERE url <> '')"""


@register("L14_add_webhook_jobs", f"""
WITH {_HOOK_URL}
SELECT * FROM v_webhook_jobs
UNION ALL
SELECT (SELECT coalesce(max(id), 0) FROM v_webhook_jobs) + row_number() OVER (ORDER BY h.id), h.id, h.spider_id, hook.url, 0, NULL
FROM v_history h JOIN hook ON hook.spider_id = h.spider_id
""")
def q_l14a(spark, sf):
    t = _t(spark, sf)
    hook = L.webhook_urls(t.settings, t.settings).where(F.col("payload_url") != "")
    todo = t.history.select(F.col("id").alias("job_id"), "spider_id").join(hook, "spider_id")
    return L.add_webhook_jobs(t.webhook_jobs, todo)


# ---------------------------------------------------------------- L15
_FORM_SQL = """
lf AS (SELECT * FROM v_forms QUALIFY row_number() OVER (PARTITION BY spider_id ORDER BY form_id DESC) = 1),
vals AS (
  SELECT spider_id, 0 AS k_no, 'concurrency' AS setting_key, coalesce(concurrency, '1') AS value FROM lf
  UNION ALL SELECT spider_id, 1, 'timeout', coalesce(timeout, '3600') FROM lf
  UNION ALL SELECT spider_id, 2, 'webhook_payload', coalesce(webhook_payload, '') FROM lf
  UNION ALL SELECT spider_id, 3, 'webhook_batch_size', coalesce(webhook_batch_size, '') FROM lf
  UNION ALL SELECT spider_id, 4, 'tag', nullif(trim(tag), '') FROM lf
  UNION ALL SELECT spider_id, 5, 'extra_requirements', nullif(trim(extra_requirements), '') FROM lf),
first AS (SELECT spider_id, setting_key, min(id) AS fid FROM v_settings GROUP BY 1, 2),
upd AS (SELECT coalesce(f.fid, (SELECT coalesce(max(id), 0) FROM v_settings) + 1 + v.spider_id * 6 + v.k_no) AS id,
               v.spider_id, v.setting_key, v.value, f.fid IS NULL AS is_new
        FROM vals v LEFT JOIN first f ON f.spider_id = v.spider_id AND f.setting_key = v.setting_key)"""


@register("L15_settings", f"""
WITH {_FORM_SQL}
SELECT * FROM v_settings WHERE id NOT IN (SELECT id FROM upd)
UNION ALL SELECT s.id, s.spider_id, s.setting_key, u.value FROM v_settings s JOIN upd u ON u.id = s.id
UNION ALL SELECT id, spider_id, setting_key, value FROM upd WHERE is_new
""")
def q_l15s(spark, sf):
    t = _t(spark, sf)
    return L.settings_upsert(t.settings, t.parameters, t.figures, t.forms)["settings"]


@register("L15_parameters", """
WITH lf AS (SELECT * FROM v_forms QUALIFY row_number() OVER (PARTITION BY spider_id ORDER BY form_id DESC) = 1),
kv AS (SELECT spider_id, trim(param_keys[i]) AS parameter_key, param_values[i] AS value, i - 1 AS pos
            FROM (SELECT *, generate_subscripts(param_keys, 1) AS i FROM lf)),
last AS (SELECT spider_id, parameter_key, arg_max(value, pos) AS value, min(pos) AS p0 FROM kv
         WHERE parameter_key <> '' GROUP BY 1, 2)
SELECT * FROM v_parameters WHERE spider_id NOT IN (SELECT spider_id FROM v_forms)
UNION ALL
SELECT (SELECT coalesce(max(id), 0) FROM v_parameters) + 1 + spider_id * (SELECT coalesce(max(len(param_keys)), 0) + 1 FROM lf) + p0, spider_id, parameter_key, value
FROM last
""")
def q_l15p(spark, sf):
    t = _t(spark, sf)
    return L.settings_upsert(t.settings, t.parameters, t.figures, t.forms)["parameters"]


@register("L15_figures", """
WITH fj AS (SELECT spider_id, arg_max(figure_json, form_id) AS figure_json FROM v_forms
            WHERE figure_json IS NOT NULL AND json_valid(figure_json) GROUP BY 1),
ff AS (SELECT spider_id, min(id) AS fid FROM v_figures GROUP BY 1),
up AS (SELECT coalesce(ff.fid, (SELECT coalesce(max(id), 0) FROM v_figures) + 1 + fj.spider_id) AS id,
              fj.spider_id, fj.figure_json AS text FROM fj LEFT JOIN ff ON ff.spider_id = fj.spider_id)
SELECT * FROM v_figures WHERE id NOT IN (SELECT id FROM up)
UNION ALL SELECT * FROM up
""")
def q_l15f(spark, sf):
    t = _t(spark, sf)
    return L.settings_upsert(t.settings, t.parameters, t.figures, t.forms)["figures"]


@register("L15_webhook_get", """
SELECT spider_id, arg_min(value, id) AS payload_url FROM v_settings
WHERE setting_key = 'webhook_payload' AND spider_id IN (SELECT spider_id FROM v_forms) GROUP BY 1
""")
def q_l15g(spark, sf):
    t = _t(spark, sf)
    return L.webhook_urls(t.settings, t.forms)


@register("L15_webhook_put", """
WITH u AS (SELECT spider_id, arg_max(webhook_payload, form_id) AS url FROM v_forms WHERE webhook_payload IS NOT NULL GROUP BY 1),
f AS (SELECT spider_id, min(id) AS fid FROM v_settings WHERE setting_key = 'webhook_payload' GROUP BY 1),
n AS (SELECT coalesce(f.fid, (SELECT coalesce(max(id), 0) FROM v_settings) + 1 + u.spider_id) AS id, u.spider_id,
             'webhook_payload' AS setting_key, u.url AS value FROM u LEFT JOIN f ON f.spider_id = u.spider_id)
SELECT * FROM v_settings WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n
""")
def q_l15u(spark, sf):
    t = _t(spark, sf)
    urls = t.forms.where(F.col("webhook_payload").isNotNull()).select(F.col("form_id").alias("put_id"), "spider_id", F.col("webhook_payload").alias("payload_url"))
    return L.put_webhook_urls(t.settings, urls)


@register("L15_webhook_delete", """
SELECT * FROM v_settings WHERE NOT (setting_key = 'webhook_payload'
  AND spider_id IN (SELECT spider_id FROM v_forms WHERE webhook_batch_size IS NULL))
""")
def q_l15d(spark, sf):
    t = _t(spark, sf)
    return L.delete_webhook_urls(t.settings, t.forms.where(F.col("webhook_batch_size").isNull()))
