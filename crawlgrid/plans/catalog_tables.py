"""The twenty catalog tables on the adapter views, with their DuckDB twins.

The columns are those of the fixed schemas that the data can fill; the others
are NULL in the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrid.sources.adapters import DriverTables
from crawlgrid.sources.catalog import SCHEMAS, job_status

VIEW_OF = {"user": "users", "user_keys": "user_keys", "projects": "projects", "spiders": "spiders", "spider_settings": "settings",
           "spider_parameters": "parameters", "triggers": "triggers", "spider_execution_queue": "queue", "job_history": "history",
           "packages": "packages", "webhook_jobs": "webhook_jobs", "nodes": "nodes", "node_keys": "node_keys", "nodesessions": "sessions",
           "spider_figure": "figures"}
# the tables a backup holds: all but these
NOT_IN_BACKUP = {"packages", "nodesessions", "spider_figure"}

SQL = {
    "project_package": "SELECT project_id, 'scrapy' AS type, arg_max(spider_list, version) AS spider_list FROM v_packages GROUP BY 1",
    "job_status": "SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) t(id)",
    "spider_webhook": "SELECT c_custkey AS id, 'http://legacy.example/' || c_custkey AS payload_url FROM customer",
    "sys_spiderplugins": "SELECT p_partkey AS id, 'plugin' || replace(p_brand, 'Brand#', '') AS name FROM part",
    "sys_spiderpluginparameters": """SELECT p_partkey * 4 + k AS id, p_partkey AS plugin_id, ['ENABLED', 'SIZE', 'KIND'][k + 1] AS key,
        ['bool', 'int', 'string'][k + 1] AS datatype FROM part, range(3) r(k)""",
}
COLUMNS = {"project_package": ["project_id", "type", "spider_list"], "job_status": ["id"], "spider_webhook": ["id", "payload_url"],
           "sys_spiderplugins": ["id", "name"], "sys_spiderpluginparameters": ["id", "plugin_id", "key", "datatype"]}


def tables(t: DriverTables) -> dict[str, DataFrame]:
    part, k = t.raw("part"), F.col("p_partkey")
    params = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(n).alias("key"), F.lit(d).alias("datatype"))
                       for i, (n, d) in enumerate((("ENABLED", "bool"), ("SIZE", "int"), ("KIND", "string")))])
    own = {
        "project_package": t.packages.groupBy("project_id").agg(F.lit("scrapy").alias("type"), F.max_by("spider_list", "version").alias("spider_list")),
        "job_status": job_status(t.spark),
        "spider_webhook": t.raw("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("http://legacy.example/"), F.col("c_custkey").cast("string")).alias("payload_url")),
        "sys_spiderplugins": part.select(k.alias("id"), F.concat(F.lit("plugin"), F.regexp_replace("p_brand", "Brand#", "")).alias("name")),
        "sys_spiderpluginparameters": part.select(k.alias("plugin_id"), F.inline(params)).select((F.col("plugin_id") * 4 + F.col("k")).alias("id"), "plugin_id", "key", "datatype"),
    }
    return {n: own[n] if n in own else getattr(t, VIEW_OF[n]) for n in SCHEMAS}


def columns(view_columns: dict[str, list[str]], name: str) -> list[str]:
    """Columns of a table that are compared: filled ones of its schema."""
    return COLUMNS.get(name) or [f.name for f in SCHEMAS[name].fields if f.name in view_columns[name]]


def digest(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """(table, rows, digest): a sum of row hashes, whatever the order."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols]))
    return df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("long")).alias("digest"))


def digest_sql(name: str, cols: list[str]) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cols) + ")"
    source = f"({SQL[name]})" if name in SQL else f"v_{VIEW_OF[name]}"
    return (f"SELECT '{name}' AS \"table\", count(*) AS rows, CAST(sum(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM {source}")


def count_sql(name: str) -> str:
    return f"SELECT '{name}' AS \"table\", count(*) AS rows FROM " + (f"({SQL[name]})" if name in SQL else f"v_{VIEW_OF[name]}")
