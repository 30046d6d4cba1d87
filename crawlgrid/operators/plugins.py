"""Spider plugins: parameter descriptors, defaults, setting operations,
validation, and user-registered setting operations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgrid.functions.text import plugin_bool

DESCRIPTOR_SCHEMA = ("name string, parameters map<string, struct<type: string, required: boolean, "
                     "default_value: string>>")


def _stored_default(v: Column) -> Column:
    """How the crawl server stores a default: truthy values as their Python
    text (true → 'True'), falsy ones as they are (false → '0' in the
    integer-typed store, 0 → '0', '' → '', null → NULL)."""
    return (F.when(v.isNull(), F.lit(None))
            .when(v == "true", F.lit("True"))
            .when(v == "false", F.lit("0"))
            .otherwise(v))


def plugin_parameters(descriptors: DataFrame) -> DataFrame:
    """Plugin descriptor JSON → one row per declared parameter. Adding a
    plugin again replaces all its rows: only the latest descriptor (highest
    plugin_id) of each name counts. A decomposable max_by, then explode."""
    d = descriptors.select("plugin_id", F.from_json("descriptor", DESCRIPTOR_SCHEMA).alias("d"))
    latest = d.groupBy(F.col("d.name").alias("plugin_name")).agg(F.max_by("d", "plugin_id").alias("d"))
    p = latest.select("plugin_name", F.explode("d.parameters").alias("key", "spec"))
    return p.select("plugin_name", "key", F.col("spec.type").alias("datatype"),
                    F.coalesce("spec.required", F.lit(False)).alias("required"),
                    _stored_default(F.col("spec.default_value")).alias("default_value"))


def plugin_defaults(params: DataFrame) -> DataFrame:
    """Per plugin, {parameter: default or ''} as JSON with sorted keys
    (values as text), plus the same as rows."""
    rows = params.select("plugin_name", "key", F.coalesce("default_value", F.lit("")).alias("default"))
    js = rows.groupBy("plugin_name").agg(F.to_json(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("key", "default"))))).alias("defaults_json"))
    return rows.join(js, "plugin_name")


def format_value(value: Column, value_type: Column) -> Column:
    """Settings-file literal: numbers and booleans as they are (Python
    spelling), anything else double-quoted."""
    return (F.when(value_type.isin("int", "float"), value)
            .when(value_type == "bool", F.when(F.lower(value).isin("true", "1"), "True").otherwise("False"))
            .otherwise(F.concat(F.lit('"'), value, F.lit('"'))))


_CUSTOM_OPS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_setting_op(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Register a user setting operation. ``fn`` receives the ops rows of
    that name (spider_id, pos, op, name, key, value, value_type) and returns
    rows (spider_id, pos, kind, name, key, value) with ``value`` already the
    settings literal. Write it with DataFrame expressions (or a pandas UDF)."""
    _CUSTOM_OPS[name] = fn


_PLUGINS: dict[str, str] = {}
STEPS = 1 << 20  # operations that one execution can give


def register_plugin(spark: SparkSession, name: str, execute: Callable[[dict], Iterable[tuple]]) -> None:
    """Register a plugin's ``execute(parameters)``: from the parameters of one
    spider (a dict of strings) it gives the setting operations in order, as
    (op, name, key, value, value_type). It becomes a Python table function."""
    @F.udtf(returnType="step int, op string, name string, key string, value string, value_type string")
    class Execute:
        def eval(self, parameters):
            for step, operation in enumerate(execute(dict(parameters or {}))):
                yield (step, *operation)

    _PLUGINS[name] = "plugin_" + re.sub(r"\W", "_", name)
    spark.udtf.register(_PLUGINS[name], Execute)


def plugin_operations(enabled: DataFrame) -> DataFrame:
    """(spider_id, pos, plugin, parameters) of the plugins that spiders have
    enabled → their setting operations, for ``apply_setting_ops``. Each
    plugin's table function is joined laterally to its own rows; operations
    keep the order of ``pos``, then that in which they came. Plugins that
    aren't registered give none."""
    spark, out = enabled.sparkSession, None
    for name, function in _PLUGINS.items():
        rows = spark.sql(f"""
            SELECT e.spider_id, CAST(e.pos AS BIGINT) * {STEPS} + o.step AS pos, o.op, o.name, o.key, o.value, o.value_type
            FROM {{mine}} e, LATERAL {function}(e.parameters) o""", mine=enabled.where(F.col("plugin") == name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no plugin is registered")
    return out


def apply_setting_ops(ops: DataFrame, custom_ops: dict | None = None) -> DataFrame:
    """D3: ordered setting operations per spider → the final settings:
    ``set_var(name, value)`` and ``set_dict(name, key, value)``; the last
    operation on the same variable / dict entry wins (max_by position, a
    decomposable aggregate); unknown operations are ignored unless
    registered (D5). ``custom_ops`` overrides the global registry."""
    builtin = ops.where(F.col("op").isin("set_var", "set_dict")).select(
        "spider_id", "pos", F.when(F.col("op") == "set_var", "var").otherwise("dict").alias("kind"),
        "name", F.when(F.col("op") == "set_dict", F.col("key")).alias("key"),
        format_value(F.col("value"), F.col("value_type")).alias("value"))
    parts = [builtin]
    for name, fn in (_CUSTOM_OPS if custom_ops is None else custom_ops).items():
        parts.append(fn(ops.where(F.col("op") == name)).select("spider_id", "pos", "kind", "name", "key", "value"))
    allops = parts[0]
    for p in parts[1:]:
        allops = allops.unionByName(p)
    return (allops.groupBy("spider_id", "kind", "name", "key")
            .agg(F.max_by("value", "pos").alias("value")))


def validate_plugin_settings(values: DataFrame, params: DataFrame) -> DataFrame:
    """Settings of a spider's plugins that fail: a required parameter
    without a value, a bool that is not 0/1/True/true/False/false or an
    integer, an int that does not parse."""
    configured = values.select("spider_id", "plugin_name").distinct()
    expected = configured.join(params, "plugin_name")
    j = expected.join(values, ["spider_id", "plugin_name", "key"], "left")
    v = F.col("value")
    problem = (F.when(v.isNull() & F.col("required"), F.lit("missing required"))
               .when(v.isNotNull() & (F.col("datatype") == "bool") & plugin_bool(v).isNull(), F.lit("invalid bool"))
               .when(v.isNotNull() & (F.col("datatype") == "int") & F.trim(v).try_cast("long").isNull(),
                     F.lit("invalid int")))
    return (j.select("spider_id", "plugin_name", "key", "value", problem.alias("problem"))
            .where(F.col("problem").isNotNull()))
