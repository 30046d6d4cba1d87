"""Registered queries for the sinks W2-W7 (W1 is with the file queries)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrid.functions.text import job_path
from crawlgrid.operators import sinks as W
from crawlgrid.operators.history import latest_package
from crawlgrid.plans import catalog_tables as C
from crawlgrid.plans.registry import register
from crawlgrid.session import scratch_dir
from crawlgrid.sources.adapters import DriverTables
from crawlgrid.sources.catalog import FOREIGN_KEYS, SCHEMAS, parents_first, primary_key, read_catalog, write_catalog

SNAPSHOT_TABLES = [n for n in SCHEMAS if n not in C.NOT_IN_BACKUP]


def _t(spark, sf):
    return DriverTables(spark, sf)


@register("W2_snapshot_catalog", " UNION ALL ".join(
    C.count_sql(n) for n in SNAPSHOT_TABLES))
def q_w2(spark, sf):
    all_tables = C.tables(_t(spark, sf))
    return W.snapshot_catalog({n: all_tables[n] for n in SNAPSHOT_TABLES}, scratch_dir(spark, "snapshot"))


def _node_snapshot(t):
    e = t.raw("events")
    return (e.groupBy("user_id").agg(F.min("ts").alias("create_time"), F.max("ts").alias("last_heartbeat"))
            .select(F.col("user_id").alias("id"), F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("name"),
                    F.concat(F.lit("10.1.0."), F.col("user_id").cast("string")).alias("client_ip"),
                    "create_time", "last_heartbeat", F.lit(1).alias("isalive"),
                    F.lit(None).cast("array<string>").alias("tags"), F.lit(False).alias("is_deleted"),
                    F.lit(None).cast("long").alias("node_key_id")))


@register("W3_restore_merge", """
WITH snap AS (SELECT user_id AS id, 'node-' || user_id AS name, '10.1.0.' || user_id AS client_ip,
                     min(ts) AS create_time, max(ts) AS last_heartbeat, 1 AS isalive,
                     CAST(NULL AS VARCHAR[]) AS tags, FALSE AS is_deleted, CAST(NULL AS BIGINT) AS node_key_id
              FROM events GROUP BY user_id)
SELECT * FROM v_nodes WHERE id NOT IN (SELECT id FROM snap)
UNION ALL SELECT * FROM snap
""")
def q_w3(spark, sf):
    t = _t(spark, sf)
    return W.restore_merge(t.nodes, _node_snapshot(t), ["id"])


# The backup lacks project 3, so its spiders are orphans, and so is all that refers to them.
def _restore_sql():
    source = {n: f"({C.SQL[n]})" if n in C.SQL else f"v_{C.VIEW_OF[n]}" for n in SNAPSHOT_TABLES}
    parts, out = [], []
    for n in parents_first(SNAPSHOT_TABLES):
        key, cut = primary_key(n), " WHERE id <> 3" if n == "projects" else ""
        parts.append(f"snap_{n} AS (SELECT * FROM {source[n]} q{cut})")
        bad = " OR ".join(f"({c} IS NOT NULL AND {c} NOT IN (SELECT {primary_key(p)} FROM ok_{p}))"
                          for c, p in FOREIGN_KEYS.get(n, {}).items() if p in source and c in _filled(n)) or "FALSE"
        parts.append(f"ok_{n} AS (SELECT * FROM snap_{n} WHERE NOT ({bad}))")
        out.append(f"SELECT '{n}' AS \"table\", (SELECT count(*) FROM ok_{n}) AS rows, (SELECT count(*) FROM snap_{n} WHERE {bad}) AS orphans")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(out)


def _filled(name):
    from crawlgrid.plans.q_reads import _VIEW_COLUMNS
    return C.columns(_VIEW_COLUMNS, name)


@register("W3_restore_catalog", _restore_sql())
def q_w3_all(spark, sf):
    root = scratch_dir(spark, "restore")
    tables = C.tables(_t(spark, sf))
    write_catalog({n: tables[n] for n in SNAPSHOT_TABLES}, f"{root}/backup")
    backup = read_catalog(spark, f"{root}/backup", SNAPSHOT_TABLES)
    backup["projects"] = backup["projects"].where("id <> 3")
    current = {n: df.limit(0) for n, df in backup.items()}
    restored, report = W.restore_catalog(current, backup, f"{root}/restored")
    orphans = report.groupBy("table", "key").agg(F.lit(1)).groupBy("table").agg(F.count(F.lit(1)).alias("orphans"))
    # one aggregate over all tables: one for each would be a plan that takes a driver's memory
    rows = reduce(DataFrame.union, [restored[n].select(F.lit(n).alias("table")) for n in SNAPSHOT_TABLES])
    rows = rows.groupBy("table").agg(F.count(F.lit(1)).alias("rows"))
    names = spark.createDataFrame([(n,) for n in SNAPSHOT_TABLES], "table string not null")
    counted = names.join(F.broadcast(rows), "table", "left").join(F.broadcast(orphans), "table", "left")  # a row for each table
    return counted.select("table", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "orphans")])


@register("W4_completion_feed", """
WITH hook AS (SELECT spider_id, arg_min(value, id) AS url FROM v_settings
              WHERE setting_key = 'webhook_payload' GROUP BY 1)
SELECT h.id AS job_id, hook.url,
       CAST(json_object('type', 'job', 'event', 'complete', 'project_name', p.name,
                        'spider_name', s.name, 'job_id', h.id) AS VARCHAR) AS body
FROM v_history h JOIN hook ON hook.spider_id = h.spider_id AND hook.url IS NOT NULL AND hook.url <> ''
JOIN v_spiders s ON s.id = h.spider_id JOIN v_projects p ON p.id = s.project_id
""")
def q_w4(spark, sf):
    t = _t(spark, sf)
    return W.completion_feed(t.history, t.spiders, t.projects, t.settings)


@register("W5_failed_job_alerts", """
SELECT h.id AS job_id, 'crawl job failed' AS subject,
       'bot:' || p.name || ' ' || chr(13) || chr(10) || 'spider:' || h.spider_name || ' ' || chr(13) || chr(10)
       || ' job_id:' || h.id || ' ' || chr(13) || chr(10) AS body,
       'ops@example.com' AS receiver
FROM v_history h JOIN v_spiders s ON s.id = h.spider_id JOIN v_projects p ON p.id = s.project_id
WHERE h.status = 3
""")
def q_w5(spark, sf):
    t = _t(spark, sf)
    return W.failed_job_alerts(t.history, t.spiders, t.projects, enabled=True, receiver="ops@example.com")


def _existing_files(t):
    """Which v1 job files exist: every job's log; items only when it scraped some."""
    s = t.spiders.select(F.col("id").alias("_sid"), F.col("project_id").alias("_pid"), F.col("name").alias("_sname"))
    p = t.projects.select(F.col("id").alias("_ppid"), F.col("name").alias("_pname"))
    j = t.history.join(s, F.col("spider_id") == F.col("_sid")).join(p, F.col("_pid") == F.col("_ppid"))
    args = (F.lit(1), "_pname", "_ppid", "_sname", "id")
    logs = j.select(job_path(*args, kind="log").alias("path"))
    items = j.where(F.col("items_count") > 0).select(job_path(*args, kind="items").alias("path"))
    return logs.unionByName(items)


@register("W6_storage_migration_manifest", """
WITH p1 AS (SELECT id AS project_id, name AS project_name FROM v_projects WHERE storage_version = 1),
jobs AS (SELECT h.id AS job_id, h.items_count, s.name AS spider_name, p1.* FROM v_history h
         JOIN v_spiders s ON s.id = h.spider_id JOIN p1 ON p1.project_id = s.project_id),
latest AS (SELECT project_id, egg_version AS version FROM (
           SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY version DESC) AS rn FROM v_packages) WHERE rn = 1)
SELECT project_id, 'log' AS kind, 'logs/' || project_name || '/' || spider_name || '/' || job_id || '.log' AS old_path,
       'projects/' || project_id || '/spiders/' || spider_name || '/jobs/' || job_id || '/job.log' AS new_path,
       NULL AS reason FROM jobs
UNION ALL
SELECT project_id, 'items', 'items/' || project_name || '/' || spider_name || '/' || job_id || '.jl',
       'projects/' || project_id || '/spiders/' || spider_name || '/jobs/' || job_id || '/items.jl', NULL
FROM jobs WHERE items_count > 0
UNION ALL
SELECT p1.project_id, 'package',
       'eggs/' || project_name || '/' || regexp_replace(l.version, '[^a-zA-Z0-9_-]', '_', 'g') || '.egg',
       'projects/' || p1.project_id || '/eggs/' || regexp_replace(l.version, '[^a-zA-Z0-9_-]', '_', 'g') || '.egg',
       CASE WHEN l.version IS NULL THEN 'no package' END
FROM p1 LEFT JOIN latest l ON l.project_id = p1.project_id
""")
def q_w6(spark, sf):
    t = _t(spark, sf)
    latest = latest_package(t.packages).select("project_id", F.col("egg_version").alias("version"))
    return W.storage_migration_manifest(t.projects, t.spiders, t.history, _existing_files(t), latest)


def _legacy_webhooks(t):
    c = t.raw("customer")
    return c.select(F.col("c_custkey").alias("id"),
                    F.concat(F.lit("http://legacy.example/"), F.col("c_custkey").cast("string")).alias("payload_url"))


_W7_HOOKS = "SELECT c_custkey AS id, 'http://legacy.example/' || c_custkey AS payload_url FROM customer"


@register("W7_upgrade_settings", f"""
SELECT * FROM v_settings
UNION ALL
SELECT (SELECT coalesce(max(id), 0) FROM v_settings) + w.id, w.id, 'webhook_payload', w.payload_url
FROM ({_W7_HOOKS}) w
""")
def q_w7s(spark, sf):
    t = _t(spark, sf)
    return W.upgrade_tables(t.users, t.projects, t.settings, _legacy_webhooks(t))["settings"]


@register("W7_upgrade_projects",
          "SELECT * REPLACE ((SELECT min(id) FROM v_users) AS owner_id) FROM v_projects")
def q_w7p(spark, sf):
    t = _t(spark, sf)
    return W.upgrade_tables(t.users, t.projects, t.settings, _legacy_webhooks(t))["projects"]


@register("W7_upgrade_users", "SELECT * REPLACE (1 AS is_active) FROM v_users")
def q_w7u(spark, sf):
    t = _t(spark, sf)
    return W.upgrade_tables(t.users, t.projects, t.settings, _legacy_webhooks(t))["users"]
