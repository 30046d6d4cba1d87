"""DuckDB twins of the adapter views in ``crawlgrid.sources.adapters``.

The oracle SQL of every registered query is ``WITH <views> <query>``; only the
views a query names are included. Keep each view equivalent to its Spark twin.
"""

from __future__ import annotations

import re

ANCHOR = "TIMESTAMP '2024-01-01 00:00:00'"
SEG = "['automobile','building','furniture','household','machinery']"


def _jid(expr: str) -> str:
    return f"('j' || CAST({expr} AS VARCHAR))"


VIEWS: dict[str, str] = {}

VIEWS["v_users"] = """
SELECT r_regionkey + 1 AS id, r_name AS username, r_regionkey = 0 AS is_admin, 1 AS is_active
FROM region"""

VIEWS["v_user_keys"] = """
SELECT c_custkey AS id, c_custkey % 160 AS user_id, 'ak' || c_custkey AS app_key,
       'as' || c_custkey AS app_secret, c_custkey % 9 <> 0 AS enabled
FROM customer"""

VIEWS["v_projects"] = """
SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS version,
       1 + n_nationkey % 2 AS storage_version,
       CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE n_regionkey + 1 END AS owner_id
FROM nation"""

VIEWS["v_spiders"] = """
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 37 = 36 THEN c_nationkey + 100 ELSE c_nationkey END AS project_id,
       c_name AS name
FROM customer"""

VIEWS["v_settings"] = f"""
SELECT c_custkey * 8 + 0 AS id, c_custkey AS spider_id, 'tag' AS setting_key,
       CASE WHEN c_custkey % 4 = 1 THEN NULL
            WHEN c_custkey % 4 = 2 THEN lower(c_mktsegment)
            ELSE lower(c_mktsegment) || ',' || {SEG}[c_nationkey % 5 + 1] END AS value
FROM customer WHERE c_custkey % 4 <> 0
UNION ALL
SELECT c_custkey * 8 + 1, c_custkey, 'timeout',
       CASE WHEN c_custkey % 29 = 0 THEN 'abc' ELSE CAST(30 + 900 * (c_custkey % 5) AS VARCHAR) END
FROM customer WHERE c_custkey % 3 <> 0
UNION ALL
SELECT c_custkey * 8 + 2, c_custkey, 'webhook_payload', 'http://hook.example/' || c_custkey
FROM customer WHERE c_custkey % 2 = 0
UNION ALL
SELECT c_custkey * 8 + 3, c_custkey, 'webhook_batch_size',
       CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE CAST(c_custkey % 6 AS VARCHAR) END
FROM customer
UNION ALL
SELECT c_custkey * 8 + 4, c_custkey, 'concurrency', CASE WHEN c_custkey % 5 = 0 THEN '2' ELSE '1' END
FROM customer WHERE c_custkey % 5 <= 1
UNION ALL
SELECT c_custkey * 8 + 5, c_custkey, 'extra_requirements', 'requests;lxml'
FROM customer WHERE c_custkey % 7 = 0
UNION ALL
SELECT c_custkey * 8 + 6, c_custkey, 'timeout', '600'
FROM customer WHERE c_custkey % 13 = 0
UNION ALL
SELECT c_custkey * 8 + 7, c_custkey, 'color', 'blue'
FROM customer WHERE c_custkey % 17 = 0"""

VIEWS["v_parameters"] = """
SELECT c_custkey * 2 AS id, c_custkey AS spider_id, 'nation' AS parameter_key,
       CAST(c_nationkey AS VARCHAR) AS value FROM customer
UNION ALL
SELECT c_custkey * 2 + 1, c_custkey, 'segment', c_mktsegment FROM customer"""

VIEWS["v_triggers"] = """
SELECT p_partkey AS id, (p_partkey * 3) // 4 AS spider_id,
  CASE WHEN p_partkey % 13 = 0 THEN
         CASE WHEN (p_partkey // 13) % 3 = 0 THEN CAST(p_size AS VARCHAR) || ' * * *'
              WHEN (p_partkey // 13) % 3 = 1 THEN '61 * * * *'
              ELSE '* * * * * *' END
       WHEN p_partkey % 8 = 0 THEN CAST(p_size % 60 AS VARCHAR) || ' * * * *'
       WHEN p_partkey % 8 = 1 THEN '*/' || (p_size % 30 + 1) || ' ' || (p_size % 24) || ' * * *'
       WHEN p_partkey % 8 = 2 THEN '0 ' || (p_size % 24) || '-23 * * mon-fri'
       WHEN p_partkey % 8 = 3 THEN (p_size % 60) || ' ' || (p_size % 24) || ' * * ' || (p_partkey % 7)
       WHEN p_partkey % 8 = 4 THEN '0 0 ' || (p_size % 28 + 1) || ' jan-jun,oct *'
       WHEN p_partkey % 8 = 5 THEN '15,45 */' || (p_size % 12 + 1) || ' * * *'
       WHEN p_partkey % 8 = 6 THEN '0 12 * ' || (p_size % 12 + 1) || ' *'
       ELSE '5/' || (p_size % 20 + 5) || ' 8-18/2 last * *' END AS cron_pattern
FROM part"""

VIEWS["v_queue"] = f"""
SELECT {_jid('o_orderkey')} AS id,
       'project_' || (o_custkey % 25) AS project_name,
       'spider_' || o_custkey AS spider_name,
       o_orderdate + to_hours(o_orderkey % 7) AS fire_time,
       CASE WHEN o_orderkey % 41 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS spider_id,
       1 AS slot,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {ANCHOR} - to_seconds(o_orderkey % 7200) END AS start_time,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderkey // 150 END AS node_id,
       CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderkey % 23 = 0 THEN 2 WHEN o_orderkey % 29 = 0 THEN 3
            WHEN o_orderkey % 5 = 0 THEN 5 ELSE 1 END AS status,
       CASE WHEN o_orderstatus = 'O' THEN o_orderdate + to_hours(o_orderkey % 7)
            ELSE {ANCHOR} - to_seconds((o_orderkey % 13) * 10) END AS update_time,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderkey % 30000 AS INTEGER) END AS pid,
       CASE WHEN o_orderkey % 3 = 0 THEN 'machinery' END AS tag,
       CASE WHEN o_orderkey % 4 = 0 THEN '{{"spider_parameters": {{"prio": "' || o_orderpriority || '"}}}}' END AS settings
FROM orders WHERE o_orderstatus IN ('O', 'P')"""

VIEWS["v_history"] = f"""
SELECT {_jid('o_orderkey')} AS id,
       'project_' || (o_custkey % 25) AS project_name,
       'spider_' || o_custkey AS spider_name,
       o_orderdate + to_hours(o_orderkey % 7) AS fire_time,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey END AS spider_id,
       o_orderdate + to_hours(o_orderkey % 7) + to_minutes(o_orderkey % 11) AS start_time,
       CASE WHEN o_orderkey % 61 = 0 THEN NULL
            ELSE o_orderdate + to_hours(o_orderkey % 7) + to_minutes(o_orderkey % 11)
                 + to_seconds(o_orderkey % 5000) END AS complete_time,
       CASE WHEN o_orderkey % 9 IN (5, 6) THEN 3 WHEN o_orderkey % 9 = 7 THEN 4
            WHEN o_orderkey % 9 = 8 THEN 6 ELSE 2 END AS status,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 8 AS INTEGER) END AS items_count
FROM orders WHERE o_orderstatus = 'F'"""

VIEWS["v_items"] = f"""
SELECT 'project_' || (l_orderkey % 7) AS project, 'spider_' || (l_orderkey % 97) AS spider,
       {_jid('l_orderkey')} AS job_id, line_no,
       CASE WHEN l_orderkey % 17 = 0 AND line_no = 3 THEN
              CASE l_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '{{"partkey": ' || l_partkey
                   WHEN 2 THEN '{{''partkey'': ' || l_partkey || '}}' WHEN 3 THEN '{{"partkey": ' || l_partkey || '}} x'
                   ELSE '{{"partkey": ' || l_partkey || '}}{{"partkey": ' || l_partkey || '}}' END
            WHEN line_no % 2 = 1 THEN
              '{{"partkey": ' || l_partkey || ', "quantity": ' || CAST(round(l_quantity) AS BIGINT)
              || ', "price": ' || CAST(round(l_extendedprice * 100) AS BIGINT) || '}}'
            ELSE '{{"partkey": ' || l_partkey || ', "suppkey": ' || l_suppkey
              || ', "ship": {{"flag": "' || l_returnflag || '"}}}}' END AS raw
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
             l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS line_no
      FROM lineitem)"""

VIEWS["v_log_text"] = f"""
SELECT 'project_' || (doc_id % 7) AS project, 'spider_' || (doc_id % 97) AS spider,
       {_jid('doc_id * 15')} AS job_id,
       text || chr(10) || '{{''downloader/request_count'': ' || (n_chars % 9) || ','
         || chr(10) || ' ''item_scraped_count'': ' || (n_chars % 50)
         || CASE WHEN n_chars % 7 = 0 THEN '' ELSE ',' END
         || CASE WHEN n_chars % 5 = 0 THEN chr(10) || ' ''log_count/ERROR'': ' || (n_chars % 3) || ',' ELSE '' END
         || CASE WHEN n_chars % 3 = 0 THEN chr(10) || ' ''log_count/WARNING'': ' || (n_chars % 4) || ',' ELSE '' END
         || chr(10) || ' ''log_count/INFO'': 7}}' AS text, doc_id, lang
FROM documents"""

VIEWS["v_logs"] = """
SELECT project, spider, job_id, CAST(u.pos AS INTEGER) AS line_no, u.line
FROM v_log_text, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                                 generate_subscripts(string_split(text, chr(10)), 1) AS pos) u"""

VIEWS["v_nodes"] = f"""
SELECT s_suppkey AS id, s_name AS name,
       '10.0.' || (s_suppkey // 256) || '.' || (s_suppkey % 256) AS client_ip,
       TIMESTAMP '2023-12-01 00:00:00' AS create_time,
       {ANCHOR} - to_seconds((s_suppkey * 7) % 180) AS last_heartbeat,
       CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE 1 END AS isalive,
       CASE WHEN s_nationkey % 7 = 0 THEN NULL
            WHEN s_nationkey % 7 = 1 THEN CAST([] AS VARCHAR[])
            ELSE [{SEG}[s_nationkey % 5 + 1], {SEG}[(s_nationkey // 5) % 5 + 1]] END AS tags,
       CASE WHEN s_suppkey % 9 = 0 THEN TRUE WHEN s_suppkey % 9 = 1 THEN NULL ELSE FALSE END AS is_deleted,
       CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS node_key_id
FROM supplier"""

VIEWS["v_node_keys"] = f"""
SELECT o_orderkey AS id, 'nk' || o_orderkey AS key, 'sk' || o_orderkey AS secret_key,
       o_orderkey % 11 = 0 AS is_deleted,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 150 END AS used_node_id,
       {ANCHOR} - to_seconds(7200 - o_orderkey % 7200) AS create_at
FROM orders"""

VIEWS["v_sessions"] = """
SELECT event_id AS id, user_id AS node_id, ts AS create_at, ts + to_seconds(event_id % 120) AS last_heartbeat
FROM events"""

VIEWS["v_beats"] = """
SELECT event_id, user_id AS node_id, user_id * 10 + event_id % 3 AS session_id, ts
FROM events WHERE event_type IN ('view', 'click')"""

VIEWS["v_logins"] = """
SELECT event_id AS attempt_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS node_id, ts
FROM events WHERE event_type IN ('signup', 'purchase')"""

VIEWS["v_reports"] = f"""
SELECT user_id AS node_id, {_jid('event_id * 3')} AS job_id, ts
FROM events WHERE event_type = 'error'"""

VIEWS["v_completions"] = f"""
SELECT event_id AS completion_id, {_jid('(event_id - event_id % 2) * 3')} AS job_id,
       CASE WHEN event_id % 4 = 0 THEN NULL
            ELSE ((event_id - event_id % 2) * 3) // 150 + CASE WHEN event_id % 10 = 1 THEN 1 ELSE 0 END END AS node_id,
       CASE WHEN event_type IN ('purchase', 'view') THEN 'success'
            WHEN event_type IN ('error', 'click') THEN 'fail' ELSE 'bogus' END AS status,
       ts
FROM events"""

VIEWS["v_packages"] = """
SELECT p_partkey AS id, CAST(p_partkey % 25 AS INTEGER) AS project_id, p_partkey AS version,
       replace(p_name, ' ', ',') AS spider_list,
       p_size || '.' || (p_partkey % 10) AS egg_version,
       sha1(p_name) AS checksum,
       'projects/' || (p_partkey % 25) || '/eggs/' || p_partkey || '.egg' AS file_path,
       CAST(DATE '2020-01-01' + CAST(p_partkey AS INTEGER) AS TIMESTAMP) AS create_date
FROM part"""

VIEWS["v_webhook_jobs"] = f"""
SELECT o_orderkey AS id, {_jid('o_orderkey + o_orderkey % 2')} AS job_id, o_custkey AS spider_id,
       'http://hook.example/' || o_custkey AS payload_url, CAST(o_orderkey % 4 AS INTEGER) AS status,
       CASE WHEN o_orderkey % 4 = 3 THEN 'error' END AS log
FROM orders WHERE o_orderstatus = 'F'"""

VIEWS["v_webhook_events"] = """
SELECT event_id, event_id * 3 AS webhook_job_id,
       CASE WHEN event_type = 'view' THEN 'start'
            WHEN event_type IN ('purchase', 'signup') THEN 'finish'
            WHEN event_type = 'error' THEN 'fail' ELSE 'restart' END AS event,
       'log ' || event_id AS log, ts
FROM events"""

VIEWS["v_requests"] = """
SELECT c_custkey AS req_id, CAST(c_custkey % 6 AS INTEGER) AS owner_id,
       CASE WHEN c_custkey % 19 = 0 THEN 99 ELSE c_nationkey END AS project_id,
       CASE WHEN c_custkey % 19 = 0 THEN 'NOSUCH' ELSE n_name END AS project_name,
       CASE WHEN c_custkey % 23 = 0 THEN 'nosuch' ELSE c_name END AS spider_name,
       CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 60) || ' * * * *'
            WHEN c_custkey % 4 = 1 THEN '0 ' || (c_custkey % 24) || ' * * *'
            WHEN c_custkey % 4 = 2 THEN '0 0 * * * *'
            ELSE '*/' || (c_custkey % 70) || ' * * * *' END AS cron
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

VIEWS["v_figures"] = """
SELECT c_custkey AS id, c_custkey AS spider_id,
       CASE WHEN c_custkey % 27 = 0 THEN '{bad'
            ELSE '{"spider_name": "fig_' || c_custkey || '", "project_name": "p' || c_nationkey
                 || '", "extra_requirements": ' || CASE WHEN c_custkey % 5 = 0 THEN '["a","b;c"]' ELSE '"a;b;;c"' END || ', '
                 || CASE WHEN c_custkey % 2 = 0 THEN '"settings": {"x": "' || c_custkey || '"}'
                         ELSE '"spider_parameters": {"y": "1", "nation": "override"}' END
                 || CASE WHEN c_custkey % 3 = 0 THEN ', "plugin_settings": {"p":{"x":1}}, "plugins": ["p"], "package": "pk"' ELSE '' END
                 || CASE WHEN c_custkey % 4 = 0 THEN ', "output": "s3://o"' ELSE '' END || '}' END AS text
FROM customer"""

VIEWS["v_forms"] = """
SELECT c_custkey AS form_id, c_custkey AS spider_id,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 3 + 1 AS VARCHAR) END AS concurrency,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(60 * (c_custkey % 10) AS VARCHAR) END AS timeout,
       CASE WHEN c_custkey % 2 = 0 THEN 'http://new.example/' || c_custkey END AS webhook_payload,
       CASE WHEN c_custkey % 3 = 0 THEN '5' END AS webhook_batch_size,
       CASE WHEN c_custkey % 4 = 0 THEN '  ' WHEN c_custkey % 4 = 1 THEN NULL
            ELSE ' ' || lower(c_mktsegment) || ' ' END AS tag,
       CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'lxml;requests' END AS extra_requirements,
       [' nation ', '', 'segment', 'nation'] AS param_keys,
       [CAST(c_nationkey AS VARCHAR), 'x', c_mktsegment, 'N' || c_nationkey] AS param_values,
       CASE WHEN c_custkey % 5 = 0 THEN '{"spider": "f"}' WHEN c_custkey % 5 = 1 THEN '{bad' END AS figure_json
FROM customer
UNION ALL
SELECT 1000000000 + c_custkey, c_custkey, '9', NULL, CASE WHEN c_custkey % 20 = 4 THEN 'http://again.example/' || c_custkey END, NULL,
       ' again', '', ['b', ' b'], ['1', '2'], CASE WHEN c_custkey % 20 = 4 THEN '[1, {"x": 2}]' ELSE '{"a": 1} x' END
FROM customer WHERE c_custkey % 10 = 4 OR c_custkey % 10 = 0"""

VIEWS["v_plugin_descriptors"] = """
SELECT p_partkey AS plugin_id,
       '{"name": "plugin' || replace(p_brand, 'Brand#', '') || '", "parameters": {"ENABLED": {"type": "bool", '
       || '"required": true, "default_value": '
       || CASE WHEN p_size % 3 = 0 THEN 'true' WHEN p_size % 3 = 1 THEN 'false' ELSE 'null' END
       || '}, "SIZE": {"type": "int", "required": ' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END
       || ', "default_value": ' || CASE WHEN p_size % 4 = 0 THEN '0' ELSE CAST(p_size AS VARCHAR) END
       || '}, "KIND": {"type": "string", "default_value": '
       || CASE WHEN p_partkey % 5 = 0 THEN '""' ELSE '"' || lower(p_type) || '"' END || '}}}' AS descriptor
FROM part"""

VIEWS["v_plugin_values"] = """
SELECT * FROM (
  SELECT c_custkey AS spider_id, 'plugin' || (c_custkey % 25 + 1) AS plugin_name, 'ENABLED' AS key,
         CASE WHEN c_custkey % 4 = 0 THEN 'True' WHEN c_custkey % 4 = 1 THEN 'foo'
              WHEN c_custkey % 4 = 2 THEN NULL ELSE '0' END AS value FROM customer
  UNION ALL
  SELECT c_custkey, 'plugin' || (c_custkey % 25 + 1), 'SIZE',
         CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE CAST(c_custkey % 50 AS VARCHAR) END FROM customer)
WHERE value IS NOT NULL"""

VIEWS["v_setting_ops"] = """
SELECT p_partkey // 8 AS spider_id, CAST(p_partkey % 8 AS INTEGER) AS pos,
       CASE WHEN p_size % 3 = 0 THEN 'set_var' WHEN p_size % 3 = 1 THEN 'set_dict' ELSE 'set_env' END AS op,
       CASE WHEN p_size % 3 = 1 THEN 'DICT_' || (p_size % 2) ELSE 'VAR_' || (p_size % 4) END AS name,
       lower(p_type) AS key,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR)
            WHEN p_partkey % 3 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END
            ELSE p_name END AS value,
       CASE WHEN p_partkey % 3 = 0 THEN 'int' WHEN p_partkey % 3 = 1 THEN 'bool' ELSE 'str' END AS value_type
FROM part"""

VIEWS["v_job_status"] = """
SELECT * FROM (VALUES (0, 'pending', 'job is not started'), (1, 'running', 'job is running'),
  (2, 'success', 'job is finished successfully'), (3, 'fail', 'job is finished with error'),
  (4, 'warning', 'job is finished with error or warning log'),
  (5, 'stopping', 'job is finished with error or warning log')) t(id, name, "desc")"""


def _deps(text: str) -> set[str]:
    return {v for v in VIEWS if re.search(r"\b" + v + r"\b", text)}


def with_views(query: str) -> str:
    """Prefix ``query`` with the CTEs of every view it needs (transitively)."""
    need: list[str] = []

    def visit(name: str):
        if name in need:
            return
        for d in sorted(_deps(VIEWS[name]) - {name}):
            visit(d)
        need.append(name)

    for v in sorted(_deps(query)):
        visit(v)
    if not need:
        return query
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]}\n)" for v in need)
    q = query.strip()
    if q.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{q[15:]}"
    if q.upper().startswith("WITH "):
        return f"WITH {ctes},\n{q[5:]}"
    return f"WITH {ctes}\n{q}"
