"""Registered queries for the plugin operators D1-D5."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlgrid.operators import plugins as D
from crawlgrid.plans.registry import register
from crawlgrid.sources.adapters import DriverTables


def _t(spark, sf):
    return DriverTables(spark, sf)


def _path(key_expr: str, field: str) -> str:
    return f"'$.parameters.\"' || {key_expr} || '\".{field}'"


_PARAMS = f"""latest AS (SELECT descriptor FROM (
    SELECT *, row_number() OVER (PARTITION BY json_extract_string(descriptor, '$.name')
                                 ORDER BY plugin_id DESC) AS rn FROM v_plugin_descriptors) WHERE rn = 1),
pk AS (SELECT json_extract_string(descriptor, '$.name') AS plugin_name,
              unnest(json_keys(descriptor, '$.parameters')) AS key, descriptor FROM latest),
params AS (
  SELECT plugin_name, key, json_extract_string(descriptor, {_path('key', 'type')}) AS datatype,
         coalesce(CAST(json_extract(descriptor, {_path('key', 'required')}) AS BOOLEAN), FALSE) AS required,
         CASE json_type(descriptor, {_path('key', 'default_value')})
              WHEN 'NULL' THEN NULL
              WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string(descriptor, {_path('key', 'default_value')}) = 'true'
                                       THEN 'True' ELSE '0' END
              ELSE json_extract_string(descriptor, {_path('key', 'default_value')}) END AS default_value
  FROM pk)"""


@register("D1_plugin_parameters", f"WITH {_PARAMS} SELECT * FROM params")
def q_d1(spark, sf):
    return D.plugin_parameters(_t(spark, sf).plugin_descriptors)


@register("D2_plugin_defaults", f"""
WITH {_PARAMS},
rows_ AS (SELECT plugin_name, key, coalesce(default_value, '') AS "default" FROM params)
SELECT r.*, j.defaults_json FROM rows_ r JOIN (
  SELECT plugin_name, CAST(to_json(map_from_entries(list((key, "default") ORDER BY key))) AS VARCHAR) AS defaults_json
  FROM rows_ GROUP BY 1) j USING (plugin_name)
""")
def q_d2(spark, sf):
    return D.plugin_defaults(D.plugin_parameters(_t(spark, sf).plugin_descriptors))


def _ops_sql(ops: str) -> str:
    return f"""
SELECT spider_id, kind, name, key, arg_max(value, pos) AS value FROM (
  SELECT spider_id, pos, CASE op WHEN 'set_var' THEN 'var' WHEN 'set_dict' THEN 'dict' ELSE 'env' END AS kind, name,
         CASE WHEN op = 'set_dict' THEN key END AS key,
         CASE WHEN op = 'set_env' THEN '"' || value || '"'
              WHEN value_type IN ('int', 'float') THEN value
              WHEN value_type = 'bool' THEN CASE WHEN lower(value) IN ('true', '1') THEN 'True' ELSE 'False' END
              ELSE '"' || value || '"' END AS value
  FROM v_setting_ops WHERE op IN ({ops}))
GROUP BY 1, 2, 3, 4"""


@register("D3_apply_setting_ops", _ops_sql("'set_var', 'set_dict'"))
def q_d3(spark, sf):
    return D.apply_setting_ops(_t(spark, sf).setting_ops, custom_ops={})


@register("D4_validate_plugin_settings", f"""
WITH {_PARAMS},
conf AS (SELECT DISTINCT spider_id, plugin_name FROM v_plugin_values),
j AS (SELECT c.spider_id, p.plugin_name, p.key, p.datatype, p.required, v.value
      FROM conf c JOIN params p ON p.plugin_name = c.plugin_name
      LEFT JOIN v_plugin_values v ON v.spider_id = c.spider_id AND v.plugin_name = p.plugin_name AND v.key = p.key)
SELECT * FROM (
  SELECT spider_id, plugin_name, key, value,
         CASE WHEN value IS NULL AND required THEN 'missing required'
              WHEN value IS NOT NULL AND datatype = 'bool'
                   AND TRY_CAST(value AS BIGINT) IS NULL AND value NOT IN ('True', 'true', 'False', 'false')
                THEN 'invalid bool'
              WHEN value IS NOT NULL AND datatype = 'int' AND TRY_CAST(trim(value) AS BIGINT) IS NULL
                THEN 'invalid int' END AS problem
  FROM j) WHERE problem IS NOT NULL
""")
def q_d4(spark, sf):
    t = _t(spark, sf)
    return D.validate_plugin_settings(t.plugin_values, D.plugin_parameters(t.plugin_descriptors))


def set_env(ops):
    """Example user operation: ``set_env(name, value)`` → an environment
    variable, always quoted."""
    return ops.select("spider_id", "pos", F.lit("env").alias("kind"), "name", F.lit(None).cast("string").alias("key"),
                      F.concat(F.lit('"'), F.col("value"), F.lit('"')).alias("value"))


@register("D5_custom_setting_op", _ops_sql("'set_var', 'set_dict', 'set_env'"))
def q_d5(spark, sf):
    D.register_setting_op("set_env", set_env)
    return D.apply_setting_ops(_t(spark, sf).setting_ops)


def _execute(parameters):
    """The plugin of the query below: a parameter's value, and an entry for it if it's enabled."""
    yield "set_var", "SIZE", None, parameters["SIZE"], "int"
    if parameters["ENABLED"] == "true":
        yield "set_dict", "ITEM_PIPELINES", "kind." + parameters["KIND"], parameters["SIZE"], "int"
        yield "set_var", "SIZE", None, str(int(parameters["SIZE"]) + 1), "int"
    yield "set_var", "KIND", None, parameters["KIND"], "string"


@register("D5_plugin_execute", """
WITH p AS (SELECT p_partkey AS spider_id, p_size AS size, lower(p_type) AS kind, p_partkey % 3 = 0 AS enabled FROM part)
SELECT spider_id, 'var' AS kind, 'SIZE' AS name, NULL AS key, CAST(size + CASE WHEN enabled THEN 1 ELSE 0 END AS VARCHAR) AS value FROM p
UNION ALL SELECT spider_id, 'var', 'KIND', NULL, '"' || kind || '"' FROM p
UNION ALL SELECT spider_id, 'dict', 'ITEM_PIPELINES', 'kind.' || kind, CAST(size AS VARCHAR) FROM p WHERE enabled
""")
def q_d5_execute(spark, sf):
    D.register_plugin(spark, "variants", _execute)
    p = _t(spark, sf).raw("part")
    parameters = F.create_map(F.lit("SIZE"), F.col("p_size").cast("string"), F.lit("KIND"), F.lower("p_type"),
                              F.lit("ENABLED"), (F.col("p_partkey") % 3 == 0).cast("string"))
    enabled = p.select(F.col("p_partkey").alias("spider_id"), F.lit(1).alias("pos"), F.lit("variants").alias("plugin"), parameters.alias("parameters"))
    return D.apply_setting_ops(D.plugin_operations(enabled))
