"""Registered queries for the scalar functions F1-F17."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlgrid.constants import CRON_RANGES, MONTH_NAMES, WEEKDAY_NAMES
from crawlgrid.functions import audit, cron, ids, text
from crawlgrid.operators.lookup import status_code
from crawlgrid.plans.registry import register
from crawlgrid.sources.adapters import DriverTables

CRON_WINDOW = ("2024-01-29 00:00:00", "2024-02-05 00:00:00")


def _t(spark, sf):
    return DriverTables(spark, sf)


# ---------------------------------------------------------------- cron oracle (DuckDB)
# The oracle tests membership of each candidate day / hour / minute in a field,
# where the Spark side expands fields to value arrays.
def _d_names(field):
    if field == "month":
        return "[" + ",".join(f"'{n}'" for n in MONTH_NAMES) + "]", 0
    if field == "day_of_week":
        return "[" + ",".join(f"'{n}'" for n in WEEKDAY_NAMES) + "]", -1
    return None, 0


def _d_parts(field):
    first = "TRY_CAST(regexp_extract(e, '^(\\d+)', 1) AS BIGINT)"
    has_last = "regexp_matches(e, '^\\d+-')"
    last = "TRY_CAST(regexp_extract(e, '^\\d+-(\\d+)', 1) AS BIGINT)"
    has_step = "contains(e, '/')"
    step = "TRY_CAST(regexp_extract(e, '/(\\d+)$', 1) AS BIGINT)"
    eff_last = f"(CASE WHEN {has_last} THEN {last} WHEN NOT {has_step} THEN {first} END)"
    return first, eff_last, has_step, step


def _d_elem_valid(field):
    lo, hi = CRON_RANGES[field]
    first, eff_last, has_step, step = _d_parts(field)
    top = f"(CASE WHEN {eff_last} IS NULL OR {eff_last} = 0 THEN {hi} ELSE {eff_last} END)"
    conds = [
        f"(regexp_full_match(e, '\\*(/\\d+)?') AND (NOT {has_step} OR coalesce({step} BETWEEN 1 AND {hi - lo}, FALSE)))",
        f"(regexp_full_match(e, '\\d+(-\\d+)?(/\\d+)?') AND coalesce({first} >= {lo}"
        f" AND ({eff_last} IS NULL OR ({eff_last} <= {hi} AND {first} <= {eff_last}))"
        f" AND (NOT {has_step} OR ({step} > 0 AND {step} <= {top} - {first})), FALSE))",
    ]
    names, _ = _d_names(field)
    if names:
        n1 = f"coalesce(list_position({names}, split_part(lower(e), '-', 1)), 0)"
        n2 = f"coalesce(list_position({names}, split_part(lower(e), '-', 2)), 0)"
        conds.append(f"(regexp_full_match(lower(e), '[a-z]+(-[a-z]+)?') AND {n1} > 0 AND "
                     f"(NOT contains(e, '-') OR ({n2} > 0 AND {n2} >= {n1})))")
    if field == "day":
        conds.append("(lower(e) = 'last')")
    return " OR ".join(conds)


def _d_elem_match(field, v, d):
    lo, hi = CRON_RANGES[field]
    first, eff_last, has_step, step = _d_parts(field)
    st = f"(CASE WHEN {has_step} THEN {step} ELSE 1 END)"
    conds = [
        f"WHEN regexp_full_match(e, '\\*(/\\d+)?') THEN ({v} - {lo}) % {st} = 0",
        f"WHEN regexp_full_match(e, '\\d+(-\\d+)?(/\\d+)?') THEN {v} >= {first} AND "
        f"{v} <= coalesce({eff_last}, {hi}) AND ({v} - {first}) % {st} = 0",
    ]
    names, off = _d_names(field)
    if names:
        n1 = f"list_position({names}, split_part(lower(e), '-', 1))"
        n2 = f"CASE WHEN contains(e, '-') THEN list_position({names}, split_part(lower(e), '-', 2)) ELSE {n1} END"
        conds.append(f"WHEN regexp_full_match(lower(e), '[a-z]+(-[a-z]+)?') THEN {v} BETWEEN {n1} + ({off}) AND ({n2}) + ({off})")
    if field == "day":
        conds.append(f"WHEN lower(e) = 'last' THEN {d} = last_day({d})")
    return "CASE " + " ".join(conds) + " ELSE FALSE END"


def _d_field_valid(expr, field):
    return f"list_bool_and(list_transform(string_split({expr}, ','), lambda e: ({_d_elem_valid(field)})))"


def _d_field_match(expr, field, v, d="NULL"):
    return f"list_bool_or(list_transform(string_split({expr}, ','), lambda e: ({_d_elem_match(field, v, d)})))"


def _d_valid(p):
    fields = ["minute", "hour", "day", "month", "day_of_week"]
    return (f"(len({p}) = 5 AND " + " AND ".join(
        f"coalesce({_d_field_valid(f'{p}[{i + 1}]', f)}, FALSE)" for i, f in enumerate(fields)) + ")")


@register("F1_cron_valid", f"""
SELECT id, cron_pattern, {_d_valid("string_split(cron_pattern, ' ')")} AS valid FROM v_triggers
""")
def q_f1(spark, sf):
    t = _t(spark, sf).triggers
    return cron.valid_patterns(t, "cron_pattern").select("id", "cron_pattern", "valid")


@register("F2_cron_fires", f"""
WITH t AS (SELECT id, spider_id, cron_pattern, string_split(cron_pattern, ' ') AS p FROM v_triggers),
ok AS (SELECT * FROM t WHERE {_d_valid("p")}),
days AS (SELECT CAST(unnest(generate_series(DATE '{CRON_WINDOW[0][:10]}', DATE '{CRON_WINDOW[1][:10]}' - 1,
                                              INTERVAL 1 DAY)) AS DATE) AS d),
dd AS (SELECT ok.*, d FROM ok, days
       WHERE {_d_field_match("p[4]", "month", "month(d)")}
         AND {_d_field_match("p[5]", "day_of_week", "isodow(d) - 1")}
         AND {_d_field_match("p[3]", "day", "day(d)", "d")}),
hh AS (SELECT dd.*, h FROM dd, range(0, 24) r(h) WHERE {_d_field_match("p[2]", "hour", "h")}),
mm AS (SELECT hh.*, m FROM hh, range(0, 60) r(m) WHERE {_d_field_match("p[1]", "minute", "m")})
SELECT id, spider_id, cron_pattern, CAST(d AS TIMESTAMP) + to_minutes(h * 60 + m) AS fire_time FROM mm
""")
def q_f2(spark, sf):
    t = _t(spark, sf).triggers
    return cron.cron_fires(t, *CRON_WINDOW)


@register("F4_split_clean", """
SELECT id, setting_key,
       list_filter(string_split(coalesce(value, ''), CASE WHEN setting_key = 'tag' THEN ',' ELSE ';' END),
                   lambda x: x <> '') AS parts
FROM v_settings WHERE setting_key IN ('tag', 'extra_requirements')
""")
def q_f4(spark, sf):
    s = _t(spark, sf).settings.where(F.col("setting_key").isin("tag", "extra_requirements"))
    parts = F.when(F.col("setting_key") == "tag", text.split_clean("value", ",")).otherwise(
        text.split_clean("value", ";"))
    return s.select("id", "setting_key", parts.alias("parts"))


_SNOW_SQL = """
SELECT event_id,
       (((epoch_us(ts) // 1000) - 1142974214000) << 22) | (1 << 17) | (1 << 12)
       | (row_number() OVER (PARTITION BY (epoch_us(ts) // 1000) ORDER BY event_id) - 1) AS snowflake_id,
       (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY (epoch_us(ts) // 1000) ORDER BY event_id) - 1 AS seq
FROM events"""


@register("F6_snowflake_assign", f"SELECT event_id, snowflake_id FROM ({_SNOW_SQL})")
def q_f6(spark, sf):
    e = _t(spark, sf).raw("events")
    return ids.snowflake_assign(e, "ts", "event_id").select("event_id", "snowflake_id")


@register("F5_snowflake_parts",
          f"SELECT event_id, ms, 1 AS datacenter, 1 AS worker, seq AS sequence FROM ({_SNOW_SQL})")
def q_f5(spark, sf):
    e = _t(spark, sf).raw("events")
    a = ids.snowflake_assign(e, "ts", "event_id")
    p = ids.snowflake_parts("snowflake_id")
    return a.select("event_id", p["ms"].alias("ms"), p["datacenter"].alias("datacenter"),
                    p["worker"].alias("worker"), p["sequence"].alias("sequence"))


@register("F7_version_order", """
SELECT project_id, id, egg_version,
       row_number() OVER (PARTITION BY project_id
                          ORDER BY list_transform(string_split(egg_version, '.'), lambda x: CAST(x AS BIGINT)), id) AS rank
FROM v_packages
""")
def q_f7(spark, sf):
    from crawlgrid.operators.ranking import row_number_within
    p = _t(spark, sf).packages.select("project_id", "id", "egg_version")
    return row_number_within(p, ["project_id"], [text.version_key("egg_version"), "id"])


@register("F8_sanitize_version", """
SELECT id, egg_version, regexp_replace(egg_version, '[^a-zA-Z0-9_-]', '_', 'g') AS safe_version FROM v_packages
""")
def q_f8(spark, sf):
    p = _t(spark, sf).packages
    return p.select("id", "egg_version", text.sanitize_version("egg_version").alias("safe_version"))


@register("F9_job_paths", """
SELECT h.id AS job_id, p.storage_version,
       CASE p.storage_version WHEN 1 THEN 'logs/' || p.name || '/' || s.name || '/' || h.id || '.log'
            WHEN 2 THEN 'projects/' || p.id || '/spiders/' || s.name || '/jobs/' || h.id || '/job.log' END AS log_path,
       CASE p.storage_version WHEN 1 THEN 'items/' || p.name || '/' || s.name || '/' || h.id || '.jl'
            WHEN 2 THEN 'projects/' || p.id || '/spiders/' || s.name || '/jobs/' || h.id || '/items.jl' END AS items_path
FROM v_history h JOIN v_spiders s ON s.id = h.spider_id JOIN v_projects p ON p.id = s.project_id
""")
def q_f9(spark, sf):
    t = _t(spark, sf)
    s = t.spiders.select(F.col("id").alias("_sid"), F.col("project_id").alias("_pid"), F.col("name").alias("_sname"))
    p = t.projects.select(F.col("id").alias("_ppid"), F.col("name").alias("_pname"), "storage_version")
    j = t.history.join(s, F.col("spider_id") == F.col("_sid")).join(p, F.col("_pid") == F.col("_ppid"))
    args = ("storage_version", "_pname", "_ppid", "_sname", "id")
    return j.select(F.col("id").alias("job_id"), "storage_version",
                    text.job_path(*args, kind="log").alias("log_path"),
                    text.job_path(*args, kind="items").alias("items_path"))


@register("F10_package_checksum", "SELECT page_id, sha1(html) AS checksum FROM pages")
def q_f10(spark, sf):
    p = _t(spark, sf).raw("pages")
    return p.select("page_id", audit.package_checksum("html").alias("checksum"))


@register("F12_iso_json_ts", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
       || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
               ELSE '.' || lpad(CAST((epoch_us(ts) % 1000000) // 1000 AS VARCHAR), 3, '0') END AS iso
FROM events
""")
def q_f12(spark, sf):
    e = _t(spark, sf).raw("events")
    return e.select("event_id", text.iso_json_ts("ts").alias("iso"))


@register("F13_to_bool", """
SELECT id, value, coalesce(lower(value) IN ('yes', 'true', 't', '1', 'on'), FALSE) AS flag,
       CASE WHEN TRY_CAST(value AS BIGINT) IS NOT NULL THEN TRY_CAST(value AS BIGINT) <> 0
            WHEN value IN ('True', 'true') THEN TRUE WHEN value IN ('False', 'false') THEN FALSE END AS plugin_flag
FROM v_settings
""")
def q_f13(spark, sf):
    s = _t(spark, sf).settings
    return s.select("id", "value", text.to_bool("value").alias("flag"), text.plugin_bool("value").alias("plugin_flag"))


@register("F14_resource_id", """
SELECT node_id, job_id, name,
       CAST(regexp_extract(name, '^nodeSessions/(\\d+)', 1) AS BIGINT) AS session_id,
       regexp_extract(name, '/jobs/([^/]+)', 1) AS parsed_job, name LIKE '%/egg' AS egg
FROM (SELECT node_id, job_id,
             'nodeSessions/' || node_id || '/jobs/' || job_id
             || CASE WHEN hash_key % 2 = 0 THEN '/egg' ELSE '' END AS name
      FROM (SELECT *, CAST(substr(job_id, 2) AS BIGINT) AS hash_key FROM v_reports))
""")
def q_f14(spark, sf):
    r = _t(spark, sf).reports
    egg = F.substring("job_id", 2, 10).cast("long") % 2 == 0
    name = F.when(egg, text.session_resource("node_id", F.col("job_id"), egg=True)).otherwise(
        text.session_resource("node_id", F.col("job_id")))
    r = r.select("node_id", "job_id", name.alias("name"))
    p = text.parse_resource("name")
    return r.select("node_id", "job_id", "name", p["session_id"].alias("session_id"),
                    p["job_id"].alias("parsed_job"), p["egg"].alias("egg"))


@register("F15_status_code", """
SELECT completion_id, status, CASE status WHEN 'success' THEN 2 WHEN 'fail' THEN 3 END AS code,
       CASE WHEN status IN ('success', 'fail') THEN status END AS name
FROM v_completions
""")
def q_f15(spark, sf):
    c = _t(spark, sf).completions
    code = status_code("status")
    return c.select("completion_id", "status", code.alias("code"), text.status_name(code).alias("name"))


_PKG_INFO = """'Metadata-Version: 1.1' || chr(10) || 'Name: ' || p_name || chr(10)
       || CASE WHEN p_partkey % 5 = 0 THEN 'Summary: none' ELSE 'Version: ' || p_size || '.' || (p_partkey % 10) END
       || chr(10)"""


@register("F16_package_info_version", f"""
SELECT p_partkey AS id, regexp_extract(info, '(^|\\n)Version:[ \\t]*(\\S*)', 2) AS version,
       regexp_matches(info, '(^|\\n)Version:') AS has_version
FROM (SELECT p_partkey, {_PKG_INFO} AS info FROM part)
""")
def q_f16(spark, sf):
    p = _t(spark, sf).raw("part")
    nl = F.lit("\n")
    info = F.concat(F.lit("Metadata-Version: 1.1"), nl, F.lit("Name: "), F.col("p_name"), nl,
                    F.when(F.col("p_partkey") % 5 == 0, F.lit("Summary: none")).otherwise(
                        F.concat(F.lit("Version: "), F.col("p_size").cast("string"), F.lit("."),
                                 (F.col("p_partkey") % 10).cast("string"))), nl)
    v = text.package_info_version(info)
    return p.select(F.col("p_partkey").alias("id"), F.coalesce(v, F.lit("")).alias("version"),
                    v.isNotNull().alias("has_version"))


def _d_pad(xor_word: int) -> str:
    return ("array_to_string(list_transform(range(16), lambda i: lpad(to_hex(xor(CAST('0x' || "
            f"substr(khex, i * 8 + 1, 8) AS BIGINT), {xor_word})), 8, '0')), '')")


# HMAC-SHA256 written independently in SQL: key padded to 64 bytes, XOR with
# the inner / outer pads word by word, two sha256 passes.
@register("F17_request_audit", f"""
WITH e AS (SELECT event_id AS request_id, 'ak' || (user_id * 10) AS k,
                  CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
                  '/api/spiders/' || user_id AS path,
                  'type=' || event_type || '&a=x y&k=' || json_extract_string(props, '$.k')
                    || CASE WHEN event_id % 3 = 0 THEN '&b=%zz%41%4' ELSE '' END AS query,
                  encode(props) AS body FROM events),
kb AS (SELECT app_key, enabled,
              CASE WHEN octet_length(encode(app_secret)) > 64 THEN unhex(sha256(encode(app_secret)))
                   ELSE encode(app_secret) END AS kbytes FROM v_user_keys),
kh AS (SELECT app_key, enabled, rpad(hex(kbytes), 128, '0') AS khex FROM kb),
pads AS (SELECT app_key, enabled, {_d_pad(0x36363636)} AS ipad, {_d_pad(0x5C5C5C5C)} AS opad FROM kh),
cq AS (SELECT request_id, array_to_string(list_transform(list_sort(list_transform(
         list_filter(string_split(query, '&'), lambda p: p <> ''),
         lambda p: {{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')),
                    'v': CASE WHEN contains(p, '=') THEN url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' '))
                              ELSE '' END}})),
         lambda x: x.k || '=' || replace(url_encode(x.v), '%2F', '/')), '&') AS cq FROM e),
d AS (SELECT e.*, pads.app_key, pads.enabled,
             CASE WHEN pads.app_key IS NOT NULL THEN
               sha256(unhex(pads.opad) || unhex(sha256(unhex(pads.ipad)
                      || encode(e.method || chr(10) || e.path || chr(10) || cq.cq || chr(10)) || e.body))) END
               AS digest
      FROM e JOIN cq USING (request_id) LEFT JOIN pads ON pads.app_key = e.k),
a AS (SELECT d.*, CASE WHEN request_id % 10 = 0 THEN 'HMAC ' || k
                       WHEN request_id % 10 = 1 THEN 'MD5 ' || k || ' x'
                       WHEN request_id % 2 = 0 THEN 'HMAC ' || k || ' ' || coalesce(digest, '00')
                       ELSE 'HMAC ' || k || ' ' || sha256(body) END AS auth FROM d)
SELECT request_id, CASE WHEN len(string_split(auth, ' ')) = 3 THEN digest END AS expected_digest,
       CASE WHEN len(string_split(auth, ' ')) <> 3 THEN 'bad header'
            WHEN string_split(auth, ' ')[1] <> 'HMAC' THEN 'bad algorithm'
            WHEN app_key IS NULL THEN 'unknown key'
            WHEN NOT enabled THEN 'deleted key'
            WHEN digest <> lower(string_split(auth, ' ')[3]) THEN 'bad digest'
            ELSE 'accepted' END AS verdict
FROM a
""")
def q_f17(spark, sf):
    """Signed requests derived from events; half carry the right signature.
    The expected digests are compared with an SQL HMAC in the oracle (and with
    Python's hmac on fixtures in tests)."""
    t = _t(spark, sf)
    e = t.raw("events")
    key = F.concat(F.lit("ak"), (F.col("user_id") * 10).cast("string"))
    req = e.select(
        F.col("event_id").alias("request_id"), key.alias("_k"),
        F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/api/spiders/"), F.col("user_id").cast("string")).alias("path"),
        F.concat(F.lit("type="), F.col("event_type"), F.lit("&a=x y&k="), F.get_json_object("props", "$.k"),
                 F.when(F.col("event_id") % 3 == 0, "&b=%zz%41%4").otherwise("")).alias("query"),
        F.encode("props", "UTF-8").alias("body"))
    keys = t.user_keys.select(F.col("app_key").alias("_k"), *[c.alias(n) for c, n in
                              zip(audit.hmac_pads(F.col("app_secret")), ["_i", "_o"])])
    msg = F.concat(F.encode(F.concat_ws("\n", "method", "path", audit.canonical_query(F.col("query")), F.lit("")),
                            "UTF-8"), F.col("body"))
    good = audit.hmac_sha256_hex(F.col("_i"), F.col("_o"), msg)
    rid = F.col("request_id")
    auth = (F.when(rid % 10 == 0, F.concat(F.lit("HMAC "), F.col("_k")))
            .when(rid % 10 == 1, F.concat(F.lit("MD5 "), F.col("_k"), F.lit(" x")))
            .when(rid % 2 == 0, F.concat(F.lit("HMAC "), F.col("_k"), F.lit(" "), F.coalesce(good, F.lit("00"))))
            .otherwise(F.concat(F.lit("HMAC "), F.col("_k"), F.lit(" "), F.sha2(F.col("body"), 256))))
    signed = req.join(keys, "_k", "left").select("request_id", auth.alias("authorization"),
                                                   "method", "path", "query", "body")
    return audit.request_audit(signed, t.user_keys).select("request_id", "expected_digest", "verdict")
