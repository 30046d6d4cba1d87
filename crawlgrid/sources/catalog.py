"""S1 read_catalog: the twenty operations tables with fixed schemas."""

from __future__ import annotations

from collections.abc import Iterable
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlgrid.constants import JOB_STATUS_ROWS

NTZ = T.TimestampNTZType()
S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "user": _st(("id", I), ("username", S), ("password", S), ("nickname", S), ("email", S),
                ("is_admin", B), ("is_active", I), ("create_at", NTZ), ("last_login", NTZ)),
    "user_keys": _st(("id", I), ("user_id", I), ("app_key", S), ("app_secret", S), ("enabled", B)),
    "projects": _st(("id", I), ("name", S), ("version", S), ("storage_version", I), ("owner_id", I)),
    "project_package": _st(("project_id", I), ("type", S), ("spider_list", S)),
    "packages": _st(("id", I), ("project_id", I), ("type", S), ("spider_list", S), ("version", I),
                    ("egg_version", S), ("checksum", S), ("file_path", S), ("create_date", NTZ)),
    "spiders": _st(("id", I), ("project_id", I), ("name", S)),
    "triggers": _st(("id", I), ("spider_id", I), ("cron_pattern", S)),
    "job_status": _st(("id", I), ("name", S), ("desc", S)),
    "spider_execution_queue": _st(("id", S), ("spider_id", I), ("slot", I), ("project_name", S),
                                  ("spider_name", S), ("fire_time", NTZ), ("start_time", NTZ),
                                  ("node_id", L), ("status", I), ("update_time", NTZ), ("pid", I),
                                  ("tag", S), ("settings", S)),
    "nodes": _st(("id", L), ("name", S), ("client_ip", S), ("create_time", NTZ),
                 ("last_heartbeat", NTZ), ("isalive", I), ("tags", S), ("is_deleted", B),
                 ("node_key_id", I)),
    "node_keys": _st(("id", I), ("key", S), ("secret_key", S), ("is_deleted", B),
                     ("used_node_id", L), ("create_at", NTZ)),
    "nodesessions": _st(("id", L), ("node_id", L), ("create_at", NTZ), ("last_heartbeat", NTZ)),
    "job_history": _st(("id", S), ("spider_id", I), ("project_name", S), ("spider_name", S),
                       ("fire_time", NTZ), ("start_time", NTZ), ("complete_time", NTZ),
                       ("status", I), ("log_file", S), ("items_file", S), ("items_count", I)),
    "spider_webhook": _st(("id", I), ("payload_url", S)),
    "webhook_jobs": _st(("id", I), ("job_id", S), ("spider_id", I), ("payload_url", S),
                        ("items_file", S), ("status", I), ("log", S)),
    "spider_settings": _st(("id", I), ("spider_id", I), ("setting_key", S), ("value", S)),
    "spider_parameters": _st(("id", I), ("spider_id", I), ("parameter_key", S), ("value", S)),
    "spider_figure": _st(("id", I), ("spider_id", I), ("text", S)),
    "sys_spiderplugins": _st(("id", I), ("name", S), ("location", S)),
    "sys_spiderpluginparameters": _st(("id", I), ("plugin_id", I), ("key", S), ("datatype", S),
                                      ("required", B), ("default_value", S)),
}


# --- fixed values: primary keys other than id, and what refers to which table's id
PRIMARY_KEYS = {"project_package": "project_id"}
FOREIGN_KEYS: dict[str, dict[str, str]] = {
    "user_keys": {"user_id": "user"},
    "projects": {"owner_id": "user"},
    "project_package": {"project_id": "projects"},
    "packages": {"project_id": "projects"},
    "spiders": {"project_id": "projects"},
    "triggers": {"spider_id": "spiders"},
    "spider_execution_queue": {"spider_id": "spiders", "status": "job_status"},
    "nodes": {"node_key_id": "node_keys"},
    "nodesessions": {"node_id": "nodes"},
    "job_history": {"spider_id": "spiders", "status": "job_status"},
    "webhook_jobs": {"job_id": "job_history", "spider_id": "spiders", "status": "job_status"},
    "spider_settings": {"spider_id": "spiders"},
    "spider_parameters": {"spider_id": "spiders"},
    "spider_figure": {"spider_id": "spiders"},
    "sys_spiderpluginparameters": {"plugin_id": "sys_spiderplugins"},
}


def primary_key(table: str) -> str:
    return PRIMARY_KEYS.get(table, "id")


def parents_first(tables: Iterable[str]) -> list[str]:
    """The tables in an order in which each comes after those it refers to."""
    left = set(tables)
    known = {t: {p for p in FOREIGN_KEYS.get(t, {}).values() if p != t} & left for t in left}
    return list(TopologicalSorter({t: sorted(known[t]) for t in sorted(left)}).static_order())


def job_status(spark: SparkSession) -> DataFrame:
    """The fixed six-row status table; safe to broadcast (size is constant)."""
    return F.broadcast(spark.createDataFrame(JOB_STATUS_ROWS, "id int, name string, desc string"))


def read_catalog(spark: SparkSession, root: str, tables: list[str] | None = None,
                 fmt: str = "parquet", jdbc_options: dict | None = None) -> dict[str, DataFrame]:
    """Load the operations tables with their fixed schemas.

    ``fmt='parquet'`` reads ``<root>/<table>`` directories. ``fmt='jdbc'``
    reads from the database at ``root``; pass ``partitionColumn`` /
    ``lowerBound`` / ``upperBound`` / ``numPartitions`` in ``jdbc_options`` so
    the big tables are read by many tasks in parallel.
    """
    out = {}
    for name in tables or list(SCHEMAS):
        if fmt == "jdbc":
            df = (spark.read.format("jdbc")
                  .options(url=root, dbtable=name, **(jdbc_options or {})).load())
            df = df.select([F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields])
        else:
            df = spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{root.rstrip('/')}/{name}")
        out[name] = df
    return out


def write_catalog(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Write operations tables under their catalog names, conformed to the
    fixed schemas (missing columns NULL, types cast), one directory each."""
    out = {}
    for name, df in tables.items():
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in SCHEMAS[name].fields]
        path = f"{root.rstrip('/')}/{name}"
        df.select(*cols).write.mode("overwrite").parquet(path)
        out[name] = path
    return out
