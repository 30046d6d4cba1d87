"""Requests with awkward rows: repeated forms and puts, lenient JSON, bad escapes, hidden titles, late ids."""

import json

import pytest
from pyspark.sql import functions as F

from crawlgrid.functions import audit, ids
from crawlgrid.operators import items as I
from crawlgrid.operators import joins as J
from crawlgrid.operators import lifecycle as L

SETTINGS = "id long, spider_id long, setting_key string, value string"
FORM = ("form_id long, spider_id long, concurrency string, timeout string, webhook_payload string, webhook_batch_size string, "
        "tag string, extra_requirements string, param_keys array<string>, param_values array<string>, figure_json string")


def form(form_id, spider_id, tag, figure=None, keys=(), values=()):
    return (form_id, spider_id, None, None, None, None, tag, None, list(keys), list(values), figure)


def submitted(spark, *forms):
    empty = lambda s: spark.createDataFrame([], s)
    return L.settings_upsert(spark.createDataFrame([(1, 1, "tag", "old")], SETTINGS), empty("id long, spider_id long, parameter_key string, value string"),
                             empty("id long, spider_id long, text string"), spark.createDataFrame(list(forms), FORM))


def test_last_form_of_a_spider_holds(spark):
    got = submitted(spark, form(2, 1, "b", None, ["x"], ["2"]), form(1, 1, "a", None, ["x", "y"], ["1", "1"]), form(3, 2, "c"))
    rows = [tuple(r) for r in got["settings"].collect()]
    assert len({r[0] for r in rows}) == len(rows) == 12
    assert {(s, v) for _, s, k, v in rows if k == "tag"} == {(1, "b"), (2, "c")} and (1, 1, "tag", "b") in rows
    assert [(r.spider_id, r.parameter_key, r.value) for r in got["parameters"].collect()] == [(1, "x", "2")]


@pytest.mark.parametrize("text, stored", [('{"a":1}', True), ("[1, 2]", True), ('"x"', True), ("null", True), ('{"a":1} x', False),
                                          ("{'a':1}", False), ('{"a":1},"b":{"c":2}', False), ("{bad", False), ("", False), (None, False)])
def test_figures_are_strict_json(spark, text, stored):
    got = submitted(spark, form(1, 1, None, '{"first": 1}'), form(2, 1, None, text))["figures"]
    assert [(r.spider_id, r.text) for r in got.collect()] == [(1, text if stored else '{"first": 1}')]


def test_last_put_of_a_spider_holds(spark):
    settings = spark.createDataFrame([(7, 1, "webhook_payload", "old"), (8, 1, "tag", "t")], SETTINGS)
    urls = spark.createDataFrame([(2, 1, "b"), (1, 1, "a"), (5, 2, "d"), (4, 2, "c")], "put_id long, spider_id long, payload_url string")
    got = sorted(tuple(r) for r in L.put_webhook_urls(settings, urls).collect())
    assert got == [(7, 1, "webhook_payload", "b"), (8, 1, "tag", "t"), (11, 2, "webhook_payload", "d")]


@pytest.mark.parametrize("text", ['{"project_name": "p"} x', "{'project_name': 'p'}", "[1]", "{bad", None])
def test_unstrict_figures_count_as_empty(spark, text):
    df = spark.createDataFrame([(text,)], "text string").withColumn("s", J.stored_figure(F.col("text")))
    f = df.select(J.figure(F.col("s"), F.lit("sp"), F.lit(None).cast("map<string,string>")).alias("f")).first().f
    assert (f.spider, f.project_name, f.plugins) == ("sp", None, "[]")


def test_figure_is_parsed_once_a_spider(spark):
    from crawlgrid.plans.registry import QUERIES, load_all
    load_all()
    plan = QUERIES["J11_job_payload"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    figures = [line for line in plan.splitlines() if "base_settings_module" in line and "from_json" in line]
    assert len(figures) <= 2 and plan.count("from_json") <= 4


def test_bad_escapes_stay(spark):
    import urllib.parse as up
    queries = ["a=%zz", "a=%41%4", "%=1&b", "a=100%&b=%e4%bd%a0", "x=1+2%2B3", "b=2&a=1&a=0", ""]
    df = spark.createDataFrame([(q,) for q in queries], "q string").select("q", audit.canonical_query(F.col("q")).alias("c"))
    for q, c in df.collect():
        pairs = sorted(up.parse_qsl(q, keep_blank_values=True))
        assert c == "&".join(f"{k}={up.quote(v)}" for k, v in pairs), q


def test_ids_stay_in_their_millisecond(spark):
    ms = 2_209_000_000_001  # slots beyond 2**53
    df = spark.range(4096).select(F.timestamp_millis(F.lit(ms)).cast("timestamp_ntz").alias("ts"), F.col("id").alias("k"))
    got = ids.snowflake_assign(df, "ts", "k").select(ids.snowflake_parts("snowflake_id").alias("p")).select("p.ms", "p.sequence").collect()
    assert {r.ms for r in got} == {ms} and sorted(r.sequence for r in got) == list(range(4096))


@pytest.mark.parametrize("html, title", [
    ("<head><!-- <title>c</title> --><title>real</title></head>", "real"),
    ('<head><script>var x = "<title>s</title>";</script><title>real</title></head>', "real"),
    ("<head><style>/* <title>s</title> */</style ><TITLE>real</TITLE></head>", "real"),
    ("<head><!-- <title>c</title></head><title>x</title>", None),
    ("<head></head><body><title>x</title></body>", None)])
def test_titles_in_comments_and_scripts_do_not_count(spark, html, title):
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert I.page_items(pages).first().title == title


def test_variant_and_map_agree(spark):
    from crawlgrid.sources import files as S
    raw = json.dumps({"a": 1, "b": {"c": [1, None]}, "d": "x"})
    r = spark.createDataFrame([(raw,)], "raw string").select(S.item_object(F.col("raw")).alias("m"), S.item_variant(F.col("raw")).alias("v")).first()
    assert r.m == {"a": "1", "b": '{"c":[1,null]}', "d": "x"} and r.v.toPython() == json.loads(raw)


def test_settings_forms_take_few_joins(spark):
    """Each table of the form's settings is met once."""
    from crawlgrid.operators.lifecycle import FORM_KEYS, settings_upsert
    settings = spark.createDataFrame([(1, 1, "tag", "a"), (2, 1, "tag", "b"), (3, 1, "color", "c"), (4, 2, "timeout", "9"), (5, 3, "tag", "x")],
                                     "id long, spider_id long, setting_key string, value string")
    forms = spark.createDataFrame([(1, 1, *([None] * 6)), (2, 1, "2", None, "u", None, " t ", ""), (3, 2, *([None] * 6))],
                                  "form_id long, spider_id long, " + ", ".join(f"{k} string" for k in FORM_KEYS)).selectExpr(
        "*", "array('k') AS param_keys", "array('v') AS param_values", "CAST(NULL AS STRING) AS figure_json")
    parameters = spark.createDataFrame([(1, 1, "k", "v")], "id long, spider_id long, parameter_key string, value string")
    figures = spark.createDataFrame([(1, 1, "{}")], "id long, spider_id long, text string")
    got = settings_upsert(settings, parameters, figures, forms)["settings"]
    rows = {(r.spider_id, r.setting_key, r.id if r.id < 6 else None): r.value for r in got.collect()}
    assert rows == {(1, "tag", 1): "t", (1, "tag", 2): "b", (1, "color", 3): "c", (3, "tag", 5): "x", (2, "timeout", 4): "3600",
                    (1, "concurrency", None): "2", (1, "timeout", None): "3600", (1, "webhook_payload", None): "u", (1, "webhook_batch_size", None): "", (1, "extra_requirements", None): None,
                    (2, "concurrency", None): "1", (2, "webhook_payload", None): "", (2, "webhook_batch_size", None): "", (2, "tag", None): None, (2, "extra_requirements", None): None}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Left") <= 3
