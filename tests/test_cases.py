"""The crawl server's own test cases, rebuilt as small DataFrames."""

import datetime as dt

import pytest
import hashlib
import hmac
from urllib.parse import parse_qs, quote

from pyspark.sql import functions as F

from conftest import rows
from crawlgrid.constants import BAD_ITEMS_LOG
from crawlgrid.functions import audit, cron, ids, text
from crawlgrid.operators import dispatch as D
from crawlgrid.operators import history as T
from crawlgrid.operators import items as I
from crawlgrid.operators import joins as J
from crawlgrid.operators import lifecycle as L
from crawlgrid.operators import logs as LG
from crawlgrid.operators import plugins as P
from crawlgrid.operators.aggregates import next_package_version

T0 = dt.datetime(2024, 3, 1, 12, 0, 0)
QUEUE = ("id string, spider_id long, slot int, project_name string, spider_name string, fire_time timestamp_ntz, "
         "start_time timestamp_ntz, node_id long, status int, update_time timestamp_ntz, pid int, tag string, "
         "settings string")
SETTINGS = "id long, spider_id long, setting_key string, value string"
NODES = ("id long, name string, client_ip string, create_time timestamp_ntz, last_heartbeat timestamp_ntz, "
         "isalive int, tags array<string>, is_deleted boolean, node_key_id long")


def qrow(id, spider_id, status, fire=T0, start=None, node=None, update=None, pid=None):
    return (id, spider_id, 1, "p", f"s{spider_id}", fire, start, node, status, update or fire, pid, None, None)


def node(id, tags=None, alive=1, key=1, hb=T0):
    return (id, f"n{id}", "127.0.0.1", T0, hb, alive, tags, False, key)


# ---------------------------------------------------------------- tags
def test_tag_matrix(spark):
    cases = [(None, None, True), (None, ["a"], False), ("a", None, False), ("a", ["a"], True),
             ("a", ["a", "b"], True), ("a", ["b"], False)]
    spiders = spark.createDataFrame([(i, 1, f"s{i}") for i in range(len(cases))], "id long, project_id long, name string")
    settings = spark.createDataFrame([(i, i, "tag", c[0]) for i, c in enumerate(cases) if c[0] is not None], SETTINGS)
    got = set()
    for i, (_, ntags, _) in enumerate(cases):
        nodes = spark.createDataFrame([node(100 + i, ntags)], NODES)
        match = D.tag_match(spiders.where(F.col("id") == i), settings, nodes)
        pairs = D.nodes_for_spiders(match, match["spiders"])
        got.add((i, pairs.count() == 1))
    assert got == {(i, c[2]) for i, c in enumerate(cases)}


def test_single_string_node_tags_are_split(spark):
    spiders = spark.createDataFrame([(1, 1, "s")], "id long, project_id long, name string")
    settings = spark.createDataFrame([(1, 1, "tag", "a,b")], SETTINGS)
    nodes = spark.createDataFrame([node(5, ["a,b"])], NODES)
    match = D.tag_match(spiders, settings, nodes)
    assert rows(D.nodes_for_spiders(match, match["spiders"])) == [(1, 5)]


# ---------------------------------------------------------------- dispatch
def test_one_job_per_spider(spark):
    settings = spark.createDataFrame([], SETTINGS)
    nodes = spark.createDataFrame([node(1)], NODES)
    asking = spark.createDataFrame([(1,)], "node_id long")
    q = spark.createDataFrame([qrow("a", 1, 0, T0), qrow("b", 1, 0, T0 + dt.timedelta(minutes=1))], QUEUE)
    first = D.next_job_per_node(q, settings, nodes, asking).collect()[0]
    assert first.job_id == "a" and first.has_job
    claimed = L.claim(q, spark.createDataFrame([("a", 1)], "job_id string, node_id long"), T0)
    second = D.next_job_per_node(claimed, settings, nodes, asking).collect()[0]
    assert second.job_id is None and not second.has_job


def test_unknown_node_is_an_error(spark):
    q = spark.createDataFrame([qrow("a", 1, 0)], QUEUE)
    out = D.next_job_per_node(q, spark.createDataFrame([], SETTINGS), spark.createDataFrame([node(1)], NODES),
                              spark.createDataFrame([(99,)], "node_id long")).collect()[0]
    assert out.error == "node not found" and not out.has_job


def test_earliest_pending_keeps_ties_and_non_pending_rows(spark):
    q = spark.createDataFrame([qrow("a", 1, 0, T0), qrow("b", 1, 0, T0), qrow("c", 1, 5, T0),
                               qrow("d", 1, 0, T0 + dt.timedelta(hours=1))], QUEUE)
    assert sorted(r.id for r in D.earliest_pending(q).collect()) == ["a", "b", "c"]


# ---------------------------------------------------------------- cancel, kill list, expiry
def test_cancel(spark):
    q = spark.createDataFrame([qrow("p", 1, 0), qrow("r", 1, 1, start=T0, node=1), qrow("s", 1, 5, start=T0)], QUEUE)
    ids = spark.createDataFrame([("p",), ("r",), ("s",), ("zz",)], "job_id string")
    out = L.cancel(q, ids, T0)
    assert rows(out["history"], "id", "status") == [("p", 6), ("r", 6)]
    assert rows(out["queue"], "id") == [("s",)]
    assert rows(out["errors"]) == [("s", "InvalidJobStatus"), ("zz", "JobNotFound")]


def test_kill_list(spark):
    q = spark.createDataFrame([qrow("mine", 1, 1, start=T0, node=1), qrow("other", 2, 1, start=T0, node=2),
                               qrow("stopping", 3, 5, start=T0, node=1), qrow("free", 4, 1, start=T0)], QUEUE)
    reps = spark.createDataFrame([(1, "mine", T0), (1, "other", T0), (1, "stopping", T0), (1, "free", T0),
                                  (1, "1", T0), (1, "2", T0)], "node_id long, job_id string, ts timestamp_ntz")
    kills = dict((r.job_id, r.reason) for r in J.kill_list(reps, q).collect())
    assert kills == {"other": "other node", "stopping": "not running", "1": "job unknown", "2": "job unknown"}
    refreshed = {r.id: r for r in J.refresh_reported(reps, q, T0 + dt.timedelta(seconds=5)).collect()}
    assert refreshed["free"].node_id == 1
    assert refreshed["mine"].update_time == T0 + dt.timedelta(seconds=5)


def test_node_expired_requeues_its_jobs(spark):
    nodes = spark.createDataFrame([node(1, hb=T0), node(2, hb=T0 + dt.timedelta(seconds=100))], NODES)
    sweep = L.node_sweep(nodes, T0 + dt.timedelta(seconds=120))
    assert rows(sweep["expired"]) == [(1,)]
    q = spark.createDataFrame([qrow("j", 1, 1, start=T0, node=1, pid=7)], QUEUE)
    j = L.requeue_from_nodes(q, sweep["expired"], T0).collect()[0]
    assert (j.status, j.node_id, j.start_time, j.pid) == (0, None, None, None)


# ---------------------------------------------------------------- timeout sweep
def _sweep(spark, start_offset, update_offset, timeout="3600"):
    q = spark.createDataFrame([qrow("j", 1, 1, start=T0, node=1, update=T0 + dt.timedelta(seconds=update_offset))], QUEUE)
    s = spark.createDataFrame([(1, 1, "timeout", timeout)], SETTINGS)
    return L.timeout_sweep(q, s, T0 + dt.timedelta(seconds=start_offset))


def test_job_timeout(spark):
    assert _sweep(spark, 3599, 3590)["actions"].count() == 0
    out = _sweep(spark, 3601, 3590)
    assert rows(out["actions"]) == [("j", "stop_fail")]
    assert rows(out["history"], "id", "status") == [("j", 3)]


def test_missing_update(spark):
    assert _sweep(spark, 59, 0)["actions"].count() == 0
    out = _sweep(spark, 61, 0)
    assert rows(out["actions"]) == [("j", "requeue")]
    j = out["queue"].collect()[0]
    assert (j.status, j.pid, j.node_id, j.start_time) == (0, None, None, T0)


def test_sweep_seconds_wrap(spark):
    # a stopping job 1 day + 60 s after its start: timedelta.seconds is 60 → not failed
    q = spark.createDataFrame([qrow("j", 1, 5, start=T0, node=1, update=T0)], QUEUE)
    s = spark.createDataFrame([], SETTINGS)
    assert L.timeout_sweep(q, s, T0 + dt.timedelta(days=1, seconds=60))["history"].count() == 0
    assert L.timeout_sweep(q, s, T0 + dt.timedelta(days=1, seconds=60), wrap=False)["history"].count() == 1


# ---------------------------------------------------------------- enqueue, retention
def test_enqueue_defaults(spark):
    req = spark.createDataFrame([("r1", 1, None)], "req_key string, spider_id long, settings string")
    spiders = spark.createDataFrame([(1, 1, "sp")], "id long, project_id long, name string")
    projects = spark.createDataFrame([(1, "pr")], "id long, name string")
    j = L.enqueue(req, spiders, projects, spark.createDataFrame([], SETTINGS), T0).collect()[0]
    assert (j.slot, j.status, j.start_time, j.node_id, j.pid, j.tag) == (1, 0, None, None, None, None)
    assert j.fire_time == j.update_time == T0 and len(j.id) == 32


def test_retention_keeps_latest_100(spark):
    h = spark.createDataFrame([(f"j{i:03d}", 1, T0 + dt.timedelta(minutes=i)) for i in range(101)],
                              "id string, spider_id long, complete_time timestamp_ntz")
    assert rows(T.history_to_purge(h), "id") == [("j000",)]
    assert T.history_after_purge(h).count() == 100


# ---------------------------------------------------------------- webhook batches
ITEMS = "job_id string, line_no int, raw string"


def test_batches_of_one(spark):
    items = spark.createDataFrame([("j", i + 1, f'{{"a": "{i + 1}"}}') for i in range(3)], ITEMS)
    sizes = spark.createDataFrame([("j", 1)], "job_id string, batch_size int")
    b = I.item_batches(items, sizes)
    assert rows(b, "batch_no", "rows", "delivered") == [(0, 1, True), (1, 1, True), (2, 1, True)]
    p = I.batch_payload(items, sizes)
    assert rows(p, "batch_no", "key", "values") == [(0, "a", ["1"]), (1, "a", ["2"]), (2, "a", ["3"])]
    body = I.form_bodies(items, sizes).where("batch_no = 0").collect()[0].body
    assert body == "a=1"


def test_bad_json_line(spark):
    items = spark.createDataFrame([("j", 1, '{"a": 1}'), ("j", 2, "{bad")], ITEMS)
    b = I.item_batches(items, spark.createDataFrame([("j", 0)], "job_id string, batch_size int"))
    r = b.collect()[0]
    assert not r.delivered and r.job_status == "fail" and r.log == BAD_ITEMS_LOG


def test_over_the_limit(spark):
    items = spark.createDataFrame([("j", 1, '{"a": "xxxxxxxxxx"}'), ("j", 2, '{"a": "y"}')], ITEMS)
    b = I.item_batches(items, spark.createDataFrame([("j", 0)], "job_id string, batch_size int"), memory_limit=10)
    r = b.collect()[0]
    assert not r.delivered and r.log.startswith("Webhook task memory usage over 10")


def test_form_encoding_matches_python(spark):
    from urllib.parse import quote_plus
    vals = ["a b", "x/y", "é", "*~", "+&="]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.e for r in df.select(I.quote_plus(F.col("v")).alias("e")).collect()]
    assert got == [quote_plus(v) for v in vals]


# ---------------------------------------------------------------- paths, versions, packages
def test_paths(spark):
    df = spark.createDataFrame([(1, "test_project", 1, "test_spider", "abc"), (2, "test_project", 1, "test_spider", "abc")],
                               "sv int, pname string, pid int, sname string, job string")
    args = ("sv", "pname", "pid", "sname", "job")
    got = rows(df.select(text.job_path(*args, kind="log").alias("l"), text.job_path(*args, kind="items").alias("i")))
    assert got == [("logs/test_project/test_spider/abc.log", "items/test_project/test_spider/abc.jl"),
                   ("projects/1/spiders/test_spider/jobs/abc/job.log", "projects/1/spiders/test_spider/jobs/abc/items.jl")]


def test_version_name_and_first_package(spark):
    assert spark.range(1).select(text.sanitize_version(F.lit("1.0"))).first()[0] == "1_0"
    projects = spark.createDataFrame([(1,)], "id long")
    packages = spark.createDataFrame([], "project_id long, version long")
    assert next_package_version(projects, packages).first().next_version == 1


def test_loose_version_order(spark):
    vs = ["1.10", "1.2", "1.2a", "2", "1.9.1"]
    df = spark.createDataFrame([(v,) for v in vs], "v string")
    got = [r.v for r in df.orderBy(text.version_key("v")).collect()]
    assert got == ["1.2", "1.2a", "1.9.1", "1.10", "2"]


def test_package_info_version(spark):
    df = spark.createDataFrame([("Name: x\nVersion: 1.2\nVersion: 9",), ("Name: y",)], "t string")
    assert [r[0] for r in df.select(text.package_info_version("t")).collect()] == ["1.2", None]


# ---------------------------------------------------------------- node keys, logins
def test_key_expiry(spark):
    keys = spark.createDataFrame([(1, "k", "s", False, None, T0 - dt.timedelta(hours=2))],
                                 "id long, key string, secret_key string, is_deleted boolean, used_node_id long, "
                                 "create_at timestamp_ntz")
    got = {(r.key_id, r.action) for r in T.node_key_rotation(keys, T0).collect()}
    assert got == {(1, "delete"), (None, "create")}


def test_anonymous_login_refused(spark):
    att = spark.createDataFrame([(1, None, T0)], "attempt_id long, node_id long, ts timestamp_ntz")
    out = L.login_decisions(att, spark.createDataFrame([node(1)], NODES),
                            spark.createDataFrame([], "id long, node_id long, create_at timestamp_ntz"))
    assert out.first().decision == "anonymous_disabled"


# ---------------------------------------------------------------- cron
def test_cron_validation(spark):
    df = spark.createDataFrame([("* * * * *",), ("* * * * * *",), ("0 0 31 feb *",), ("*/60 * * * *",), ("0 0 last * mon-fri",), ("0 0 * * fri-mon",), (None,)], "p string")
    got = {r.p: r.valid for r in cron.valid_patterns(df, "p").collect()}
    assert got == {"* * * * *": True, "* * * * * *": False, "0 0 31 feb *": True, "*/60 * * * *": False, "0 0 last * mon-fri": True, "0 0 * * fri-mon": False, None: got[None]}
    assert not got[None]


def test_cron_weekday_zero_is_monday_and_fields_and(spark):
    t = spark.createDataFrame([(1, "0 9 1-7 * 0")], "id long, cron_pattern string")
    fires = [r.fire_time for r in cron.cron_fires(t, "2024-01-01 00:00:00", "2024-03-01 00:00:00").collect()]
    # the first Monday of each month only (day 1-7 AND Monday)
    assert sorted(fires) == [dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 2, 5, 9)]


# ---------------------------------------------------------------- logs
def test_error_count_zero_still_fails(spark):
    logs = spark.createDataFrame([("j", 1, " 'item_scraped_count': 12,"), ("j", 2, " 'log_count/ERROR': 0,")],
                                 "job_id string, line_no int, line string")
    f = LG.log_facts(logs).first()
    assert (f.items_count, f.errors, f.warnings) == (12, 0, None)
    st = spark.range(1).select(LG.final_status(F.lit(2), F.lit(0), F.lit(None)).alias("s")).first().s
    assert st == 3


# ---------------------------------------------------------------- figure, plugins
def test_figure_defaults(spark):
    jobs = spark.createDataFrame([(None, "sp")], "text string, name string")
    f = jobs.select(J.figure(J.stored_figure(F.col("text")), F.col("name"), F.lit(None).cast("map<string,string>")).alias("f")).first().f
    assert f.extra_requirements == [] and f.spider_parameters == {} and f.project_name is None and f.spider == "sp"


def test_plugin_validation(spark):
    desc = spark.createDataFrame([(1, '{"name": "splitvariants", "parameters": {"ENABLED": {"type": "bool", '
                                      '"required": true, "default_value": true}}}')], "plugin_id long, descriptor string")
    params = P.plugin_parameters(desc)
    assert rows(params) == [("splitvariants", "ENABLED", "bool", True, "True")]
    vals = spark.createDataFrame([(1, "splitvariants", "ENABLED", "True"), (2, "splitvariants", "ENABLED", "foo"),
                                  (3, "splitvariants", "OTHER", "x")],
                                 "spider_id long, plugin_name string, key string, value string")
    bad = rows(P.validate_plugin_settings(vals, params), "spider_id", "problem")
    assert bad == [(2, "invalid bool"), (3, "missing required")]


def test_setting_ops_last_wins(spark):
    ops = spark.createDataFrame([(1, 0, "set_dict", "SPIDER_MIDDLEWARES", "m.X", "100", "int"),
                                 (1, 1, "set_var", "SPLITVARIANTS_ENABLED", None, "true", "bool"),
                                 (1, 2, "set_var", "SPLITVARIANTS_ENABLED", None, "false", "bool"),
                                 (1, 3, "nope", "X", None, "1", "int")],
                                "spider_id long, pos int, op string, name string, key string, value string, value_type string")
    got = rows(P.apply_setting_ops(ops, custom_ops={}), "kind", "name", "value")
    assert got == [("dict", "SPIDER_MIDDLEWARES", "100"), ("var", "SPLITVARIANTS_ENABLED", "False")]


# ---------------------------------------------------------------- signatures, ids
def _py_digest(secret, method, path, query, body):
    pq = parse_qs(query, keep_blank_values=True)
    cq = ["=".join((k, quote(v))) for k in sorted(pq) for v in sorted(pq[k])]
    return hmac.new(secret.encode(), "\n".join((method, path, "&".join(cq), "")).encode() + body,
                    hashlib.sha256).hexdigest()


def test_request_audit_matches_python_hmac(spark):
    keys = spark.createDataFrame([("k1", "s3cr3t", True), ("k2", "x" * 100, True), ("k3", "z", False)],
                                 "app_key string, app_secret string, enabled boolean")
    q = "b=2&a=x y&a=b/c*~&c="
    reqs = [(0, f"HMAC k1 {_py_digest('s3cr3t', 'POST', '/p', q, b'body')}", "POST", "/p", q, b"body"),
            (1, f"HMAC k2 {_py_digest('x' * 100, 'GET', '/p', '', b'')}", "GET", "/p", "", b""),
            (2, "HMAC k3 00", "GET", "/p", "", b""), (3, "HMAC k1 00", "GET", "/p", "", b""),
            (4, "HMAC k9 00", "GET", "/p", "", b""), (5, "MD5 k1 00", "GET", "/p", "", b""), (6, "HMAC k1", "GET", "/p", "", b"")]
    df = spark.createDataFrame(reqs, "request_id int, authorization string, method string, path string, query string, body binary")
    got = dict((r.request_id, r.verdict) for r in audit.request_audit(df, keys).collect())
    assert got == {0: "accepted", 1: "accepted", 2: "deleted key", 3: "bad digest", 4: "unknown key",
                   5: "bad algorithm", 6: "bad header"}


def test_snowflake_overflow_moves_to_next_ms(spark):
    ts = [(i, dt.datetime(2024, 1, 1, 0, 0, 0, 1000)) for i in range(4100)] + [(9999, dt.datetime(2024, 1, 1, 0, 0, 0, 2000))]
    df = spark.createDataFrame(ts, "rid long, ts timestamp_ntz")
    out = ids.snowflake_assign(df, "ts", "rid").select("rid", ids.snowflake_parts("snowflake_id").alias("p"))
    got = {r.rid: (r.p.ms, r.p.sequence) for r in out.collect()}
    base = 1704067200001
    assert got[4095] == (base, 4095) and got[4096] == (base + 1, 0) and got[9999] == (base + 1, 4)
    assert len({v for v in got.values()}) == len(got)


def test_parse_resource(spark):
    df = spark.createDataFrame([("nodeSessions/5/jobs/abc/egg",), ("nodeSessions/5",), ("x",)], "n string")
    got = [r.p for r in df.select(text.parse_resource("n").alias("p")).collect()]
    assert (got[0].session_id, got[0].job_id, got[0].egg) == (5, "abc", True)
    assert (got[1].session_id, got[1].job_id, got[1].egg) == (5, None, False) and got[2] is None


# ---------------------------------------------------------------- skew-safe numbering
def test_row_numbers_for_a_hot_key(spark):
    from pyspark.sql.window import Window
    from crawlgrid.operators.ranking import row_number_within
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 100).alias("g"),
        (F.col("id") * 7919 % 10007).alias("o"), F.col("id").alias("pk"))
    a = row_number_within(df, ["g"], [F.col("o").desc(), "pk"], partitions=8)
    b = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("o").desc(), "pk")))
    assert a.count() == b.count()
    assert a.select("pk", "rank").exceptAll(b.select("pk", "rank")).count() == 0


# ---------------------------------------------------------------- no caps, strict lines
def test_long_keys_stay_distinct(spark):
    from crawlgrid.sources.adapters import job_id
    ids = spark.range(12345678901, 12345678911).select(job_id(F.col("id")).alias("j"))
    assert ids.distinct().count() == 10


def test_seventy_parameters_get_their_own_ids(spark):
    forms = spark.createDataFrame([(s, s, None, None, None, None, None, None, [f"k{i}" for i in range(70)], ["v"] * 70, None) for s in (1, 2)],
                                  "form_id long, spider_id long, concurrency string, timeout string, webhook_payload string, webhook_batch_size string, "
                                  "tag string, extra_requirements string, param_keys array<string>, param_values array<string>, figure_json string")
    empty = lambda s: spark.createDataFrame([], s)
    got = L.settings_upsert(empty(SETTINGS), empty("id long, spider_id long, parameter_key string, value string"),
                            empty("id long, spider_id long, text string"), forms)["parameters"]
    assert got.count() == got.select("id").distinct().count() == 140


def test_purge_drains_a_long_history(spark):
    h = spark.range(1200).select(F.col("id"), F.lit(1).alias("spider_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("complete_time"))
    gone = T.history_to_purge(h)
    assert gone.count() == 1100 and gone.agg(F.max("id")).first()[0] == 1099
    assert T.history_after_purge(h).count() == 100
    assert T.history_to_purge(h, scan=1000).count() == 900


def test_item_lines_are_strict_json(spark):
    from crawlgrid.sources.files import parse_items
    lines = ["{'a': 1}", '{"a":1} x', '{"a":1}{"b":2}', '{"a":1}]', '{"a":1}}', '{"a":1},{"b":2}', "", "  ", "[1]", "null", '"a"', "{bad",
             '{"a": 1}', ' {"a": {"b": [1, 2]}}\t', "{}"]
    got = parse_items(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, raw string")).orderBy("k").collect()
    assert [r.bad for r in got] == [True] * 12 + [False] * 3
    assert got[13].item == {"a": '{"b":[1,2]}'}


def test_session_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace
    from crawlgrid.session import ensure_checkpoint_dir
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(bare)


def test_logins_of_one_batch_see_each_other(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    att = spark.createDataFrame([(1, 1, at(0)), (2, 1, at(59)), (3, 1, at(60)), (4, 1, at(100)), (5, 2, at(0)), (6, 2, at(30)), (7, 2, at(30)), (8, 9, at(0))],
                                "attempt_id long, node_id long, ts timestamp_ntz")
    sessions = spark.createDataFrame([(1, 2, at(-30)), (2, 2, at(-100))], "id long, node_id long, create_at timestamp_ntz")
    out = L.login_decisions(att, spark.createDataFrame([node(1), node(2)], NODES), sessions)
    assert dict(rows(out, "attempt_id", "decision")) == {
        1: "new_session", 2: "conflict", 3: "replace", 4: "conflict", 5: "conflict", 6: "replace", 7: "conflict", 8: "not_found"}


def test_figure_requirements_as_list_or_text(spark):
    from crawlgrid.operators.joins import spider_figures
    figs = spark.createDataFrame([(1, 1, '{"extra_requirements": ["scrapy", "b;c"], "plugins": ["x"]}'), (2, 2, '{"extra_requirements": "a;;b", "package": "p"}'), (3, 3, "{bad")],
                                 "id long, spider_id long, text string")
    spiders = spark.createDataFrame([(i, 1, f"s{i}") for i in (1, 2, 3)], "id long, project_id long, name string")
    got = {r.spider_id: r.figure for r in spider_figures(spiders, spark.createDataFrame([], "id long, spider_id long, parameter_key string, value string"), figs).collect()}
    assert [got[i].extra_requirements for i in (1, 2, 3)] == [["scrapy", "b;c"], ["a", "b"], []]
    assert (got[1].plugins, got[2].plugins, got[2].package, got[3].spider) == ('["x"]', "[]", "p", "s3")


def test_page_titles_of_the_head(spark):
    from crawlgrid.operators.items import page_items
    cases = [("<html><head><title>A &amp; B &#8211; C&nbsp;D &#x1F600; &bogus; R&D</title></head>", "A & B – C\u00a0D 😀 &bogus; R&D"),
             ("<html><head></head><body><svg><title>no</title></svg></body>", None),
             ("<html><body><title>no</title>", None), ("<TITLE lang='x'>top</TITLE><p>", "top"), (None, None), ("<title></title>", "")]
    df = spark.createDataFrame([(i, None, h) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    assert {r.page_id: r.title for r in page_items(df).collect()} == {i: t for i, (_, t) in enumerate(cases)}


def test_zone_aware_times_end_in_z(spark):
    df = spark.sql("SELECT timestamp '2024-01-02 03:04:05 UTC' AS a, timestamp '2024-01-02 03:04:05.25+02:00' AS b")
    r = df.select(text.iso_json_ts("a", True).alias("a"), text.iso_json_ts("b", True).alias("b")).first()
    assert (r.a, r.b) == ("2024-01-02T03:04:05Z", "2024-01-02T01:04:05.250Z")
