"""String / path / version / time helpers (F4, F7-F9, F12-F16), all native
Column expressions so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgrid.constants import (TRUE_WORDS, V1_ITEMS_PATH, V1_LOG_PATH, V1_PACKAGE_PATH, V2_ITEMS_PATH,
                                 V2_LOG_PATH, V2_PACKAGE_PATH)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_clean(s, sep: str = ",") -> Column:
    """split on ``sep``, drop blank parts; NULL → empty array."""
    parts = F.split(F.coalesce(_c(s), F.lit("")), "\\" + sep if sep in ".|*+?^$()[]{}\\" else sep, -1)
    return F.filter(parts, lambda x: x != "")


def split_list(arr, sep: str = ",") -> Column:
    """F4 for list values: a one-element list 'a,b' is split, longer lists kept."""
    a = _c(arr)
    return F.when(F.size(a) == 1, split_clean(F.get(a, 0), sep)).otherwise(
        F.coalesce(a, F.array().cast("array<string>")))


def version_key(v) -> Column:
    """loose version order key: digit runs as numbers, letter runs as text.
    Numbers sort before text at the same position."""
    toks = F.regexp_extract_all(F.lower(_c(v)), F.lit(r"(\d+|[a-z]+|[^0-9a-z.]+)"), 1)
    return F.transform(toks, lambda t: F.struct(
        (~F.regexp_like(t, F.lit(r"^\d+$"))).alias("is_text"),
        F.when(F.regexp_like(t, F.lit(r"^\d+$")), t.try_cast("decimal(38,0)")).alias("num"),
        F.when(~F.regexp_like(t, F.lit(r"^\d+$")), t).alias("text")))


def sanitize_version(v) -> Column:
    """F8: characters outside [a-zA-Z0-9_-] become '_'."""
    return F.regexp_replace(_c(v), r"[^a-zA-Z0-9_-]", "_")


def job_path(storage_version, project_name, project_id, spider_name, job_id, kind: str) -> Column:
    """where a job's log / items live for storage layout 1 or 2; NULL for
    an unknown layout."""
    sv = _c(storage_version)
    if kind == "log":
        v1 = F.format_string(V1_LOG_PATH, _c(project_name), _c(spider_name), _c(job_id))
        v2 = F.format_string(V2_LOG_PATH, _c(project_id), _c(spider_name), _c(job_id))
    elif kind == "items":
        v1 = F.format_string(V1_ITEMS_PATH, _c(project_name), _c(spider_name), _c(job_id))
        v2 = F.format_string(V2_ITEMS_PATH, _c(project_id), _c(spider_name), _c(job_id))
    else:
        raise ValueError(kind)
    return F.when(sv == 1, v1).when(sv == 2, v2)


def package_path(storage_version, project_name, project_id, version) -> Column:
    """package file of a project version (version sanitized as F8)."""
    sv = _c(storage_version)
    v = sanitize_version(_c(version).cast("string"))
    return (F.when(sv == 1, F.format_string(V1_PACKAGE_PATH, _c(project_name), v))
            .when(sv == 2, F.format_string(V2_PACKAGE_PATH, _c(project_id), v)))


def iso_json_ts(ts, zone_aware: bool = False) -> Column:
    """ISO-8601 text; milliseconds appear only when micros are non-zero. A
    zone-aware time (TIMESTAMP, an instant) is written in UTC with a ``Z``."""
    if zone_aware:
        return F.concat(iso_json_ts(F.to_utc_timestamp(_c(ts), F.current_timezone())), F.lit("Z"))
    t = _c(ts)
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(t.cast("timestamp")) % 1000000
    return F.when(t.isNull(), F.lit(None)).when(micros == 0, base).otherwise(
        F.concat(base, F.lit("."), F.date_format(t, "SSS")))


def to_bool(s) -> Column:
    """F13 (settings): yes/true/t/1/on in any case → true, anything else false."""
    return F.coalesce(F.lower(_c(s)).isin(*TRUE_WORDS), F.lit(False))


def plugin_bool(s) -> Column:
    """F13 (plugin parameters): an integer, or True/true/False/false; else NULL."""
    x = _c(s)
    as_int = x.try_cast("long")
    return (F.when(as_int.isNotNull(), as_int != 0)
            .when(x.isin("True", "true"), F.lit(True))
            .when(x.isin("False", "false"), F.lit(False)))


def session_resource(session_id, job_id=None, egg: bool = False) -> Column:
    """``nodeSessions/<id>[/jobs/<job>[/egg]]``."""
    r = F.concat(F.lit("nodeSessions/"), _c(session_id).cast("string"))
    if job_id is not None:
        r = F.concat(r, F.lit("/jobs/"), _c(job_id))
        if egg:
            r = F.concat(r, F.lit("/egg"))
    return r


def parse_resource(name) -> Column:
    """F14 inverse: struct(session_id, job_id, egg) or NULL when it does not parse."""
    n = _c(name)
    pat = r"^nodeSessions/(\d+)(/jobs/([^/]+)(/egg)?)?$"
    ok = F.regexp_like(n, F.lit(pat))
    return F.when(ok, F.struct(
        F.regexp_extract(n, pat, 1).try_cast("long").alias("session_id"),
        F.nullif(F.regexp_extract(n, pat, 3), F.lit("")).alias("job_id"),
        (F.regexp_extract(n, pat, 4) != "").alias("egg")))


def status_name(code) -> Column:
    """status code → word used by the agents' completion reports."""
    c = _c(code)
    return F.when(c == 2, "success").when(c == 3, "fail")


def package_info_version(text) -> Column:
    """F16: first line starting with ``Version:`` → the following token."""
    t = _c(text)
    return F.when(F.regexp_like(t, F.lit(r"(?m)^Version:")),
                  F.regexp_extract(t, r"(?m)^Version:[ \t]*(\S*)", 1))
