"""Set-based job, node, session, key, webhook-job and settings transitions.

The crawl server mutates one ORM row at a time and commits. Each operator
here takes the current tables plus a batch of events and returns the *new*
tables (or a decision table); nothing is updated in place. ``as_of`` is a
timestamp string or a Column (e.g. a scalar subquery) and replaces every
``now()`` of the reference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrid.constants import (CANCEL, DEFAULT_JOB_TIMEOUT, FAIL, KILL_GRACE, NODE_TIMEOUT, PENDING,
                                 RUNNING, SESSION_GUARD, STOPPING, UPDATE_GRACE)
from crawlgrid.operators.aggregates import dedupe_eav
from crawlgrid.operators.ranking import row_number_within
from crawlgrid.sources.files import json_variant

NTZ = "timestamp_ntz"

def ts(as_of) -> Column:
    return as_of.cast(NTZ) if isinstance(as_of, Column) else F.lit(as_of).cast(NTZ)


def _plus(t: Column, secs: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(secs), t)


def to_history(q: DataFrame, complete_time: Column, status: Column,
               items_count: Column | None = None) -> DataFrame:
    """Queue rows → history rows (the columns the reference copies)."""
    return q.select("id", "spider_id", "project_name", "spider_name", "fire_time", "start_time",
                    complete_time.alias("complete_time"), status.cast("int").alias("status"),
                    (items_count if items_count is not None else F.lit(None)).cast("int").alias("items_count"))


def _replace(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- L1-L8 jobs
def enqueue(requests: DataFrame, spiders: DataFrame, projects: DataFrame, settings: DataFrame,
            as_of, expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """L1: (req_key, spider_id, settings JSON or NULL) requests → pending queue
    rows. The id is md5 of the request key, so a retried batch yields the same
    ids instead of duplicates. The tag is copied from the spider's setting.

    ``expand`` makes several keyed requests of each one that has met its
    spider (the fires of a trigger), so that these aren't shuffled for it."""
    tag = dedupe_eav(settings.where(F.col("setting_key") == "tag"), "spider_id", "setting_key").select(
        F.col("spider_id").alias("_tsid"), F.col("value").alias("tag"))
    s = spiders.select(F.col("id").alias("_sid"), F.col("project_id").alias("_spid"), F.col("name").alias("spider_name"))
    p = projects.select(F.col("id").alias("_pid"), F.col("name").alias("project_name"))
    now = ts(as_of)
    # one row per spider first; the requests are shuffled once
    sp = s.join(tag, F.col("_sid") == F.col("_tsid"), "left").join(p, F.col("_spid") == p._pid)
    j = requests.join(sp, requests.spider_id == sp._sid)
    if expand is not None:
        j = expand(j)
    return j.select(
        F.md5(F.col("req_key").cast("string")).alias("id"), "spider_id", F.lit(1).alias("slot"),
        "project_name", "spider_name", now.alias("fire_time"), F.lit(None).cast(NTZ).alias("start_time"),
        F.lit(None).cast("long").alias("node_id"), F.lit(PENDING).alias("status"), now.alias("update_time"),
        F.lit(None).cast("int").alias("pid"), "tag", F.col("settings").cast("string").alias("settings"))


def claim(queue: DataFrame, assignments: DataFrame, as_of) -> DataFrame:
    """L2: chosen (job_id, node_id) pairs → running, start = update = as_of.
    A job offered to several nodes goes to the lowest node id."""
    a = assignments.groupBy("job_id").agg(F.min("node_id").alias("_node"))
    j = queue.join(a, queue.id == a.job_id, "left").drop("job_id")
    hit = F.col("_node").isNotNull()
    now = ts(as_of)
    return _replace(j, status=F.when(hit, F.lit(RUNNING)).otherwise(F.col("status")),
                    start_time=F.when(hit, now).otherwise(F.col("start_time")),
                    update_time=F.when(hit, now).otherwise(F.col("update_time")),
                    node_id=F.when(hit, F.col("_node")).otherwise(F.col("node_id"))).drop("_node")


def mark_started(queue: DataFrame, starts: DataFrame, as_of) -> DataFrame:
    """L3: a job's process started: start_time and pid are set only if still
    NULL (first report by ts wins), update_time always."""
    s = starts.groupBy("job_id").agg(F.min_by("pid", F.struct("ts", "pid")).alias("_pid"))
    j = queue.join(s, queue.id == s.job_id, "left")
    hit = F.col("job_id").isNotNull()
    now = ts(as_of)
    return _replace(j, start_time=F.when(hit, F.coalesce("start_time", now)).otherwise(F.col("start_time")),
                    pid=F.when(hit, F.coalesce(F.col("pid"), F.col("_pid").cast("int"))).otherwise(F.col("pid")),
                    update_time=F.when(hit, now).otherwise(F.col("update_time"))).drop("job_id", "_pid")


def cancel(queue: DataFrame, ids: DataFrame, as_of) -> dict[str, DataFrame]:
    """L4: cancel pending / running jobs: they leave the queue for history with
    status 6 and complete_time = as_of. Unknown ids → 'JobNotFound', other
    states → 'InvalidJobStatus'."""
    want = ids.select("job_id").distinct()
    ok = queue.where(F.col("status").isin(PENDING, RUNNING)).join(want, queue.id == want.job_id, "left_semi")
    errs = (want.join(queue.select(F.col("id").alias("_qid"), F.col("status").alias("_qs")),
                      F.col("job_id") == F.col("_qid"), "left")
            .select("job_id", F.when(F.col("_qid").isNull(), F.lit("JobNotFound"))
                    .when(~F.col("_qs").isin(PENDING, RUNNING), F.lit("InvalidJobStatus")).alias("error"))
            .where(F.col("error").isNotNull()))
    return {"queue": queue.join(ok.select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti"),
            "history": to_history(ok, ts(as_of), F.lit(CANCEL)),
            "errors": errs}


def finish(queue: DataFrame, accepted: DataFrame, facts: DataFrame, as_of) -> dict[str, DataFrame]:
    """Accepted completions (P5) → history rows with the final status of
    I2 and the scraped count from the log facts; the jobs leave the queue.
    A job completed twice in the batch keeps its first completion."""
    from crawlgrid.operators.logs import final_status
    first = accepted.groupBy("job_id").agg(F.min_by("status_code", F.struct("ts", "completion_id")).alias("_code"))
    j = (queue.join(first, queue.id == first.job_id)
         .join(facts.withColumnRenamed("job_id", "_fjob"), F.col("id") == F.col("_fjob"), "left"))
    status = final_status(F.col("_code"), F.col("errors"), F.col("warnings"))
    return {"queue": queue.join(first.select(F.col("job_id").alias("_gone")), F.col("id") == F.col("_gone"),
                                "left_anti"),
            "history": to_history(j, ts(as_of), status, F.col("items_count"))}


def move_completed(queue: DataFrame) -> dict[str, DataFrame]:
    """Queue rows already in status 2 / 3 move to history, complete_time =
    update_time, no item count (done at start-up by the reference)."""
    done = F.col("status").isin(2, 3)
    return {"queue": queue.where(~done),
            "history": to_history(queue.where(done), F.col("update_time"), F.col("status"))}


def timeout_sweep(queue: DataFrame, settings: DataFrame, as_of, wrap: bool = True) -> dict[str, DataFrame]:
    """The periodic sweep.

    Stage 1, running jobs: past start + timeout (spider setting, default 3600
    s; unreadable values count as default) → stopping; else no update for
    more than 60 s → pending again (pid, node cleared; start_time kept). Both
    set update_time = as_of.
    Stage 2, every stopping job (including those just stopped): elapsed
    seconds since start > 120 → history with status 3, complete_time =
    update_time. With ``wrap`` the elapsed seconds are the seconds-of-day
    part of the difference (as the reference's ``timedelta.seconds``).
    """
    now = ts(as_of)
    to = (dedupe_eav(settings.where(F.col("setting_key") == "timeout"), "spider_id", "setting_key")
          .select(F.col("spider_id").alias("_tsid"), F.trim("value").try_cast("long").alias("_timeout")))
    j = queue.join(to, queue.spider_id == to._tsid, "left")
    timeout = F.coalesce("_timeout", F.lit(DEFAULT_JOB_TIMEOUT))
    running = F.col("status") == RUNNING
    stop = running & (now > F.timestamp_add("SECOND", timeout, F.col("start_time")))
    requeue = running & ~F.coalesce(stop, F.lit(False)) & (now > _plus(F.col("update_time"), UPDATE_GRACE))
    stop, requeue = F.coalesce(stop, F.lit(False)), F.coalesce(requeue, F.lit(False))
    s1 = j.select(*queue.columns,
                  F.when(stop, "stop").when(requeue, "requeue").alias("_act"))
    s1 = _replace(s1, status=F.when(F.col("_act") == "stop", F.lit(STOPPING))
                  .when(F.col("_act") == "requeue", F.lit(PENDING)).otherwise(F.col("status")),
                  update_time=F.when(F.col("_act").isNotNull(), now).otherwise(F.col("update_time")),
                  pid=F.when(F.col("_act") == "requeue", F.lit(None)).otherwise(F.col("pid")),
                  node_id=F.when(F.col("_act") == "requeue", F.lit(None)).otherwise(F.col("node_id")))
    elapsed = F.timestamp_diff("SECOND", F.col("start_time"), now)
    if wrap:
        elapsed = F.pmod(elapsed, F.lit(86400))
    kill = (F.col("status") == STOPPING) & F.coalesce(elapsed > KILL_GRACE, F.lit(False))
    s2 = s1.withColumn("_kill", kill)
    killed = s2.where("_kill")
    actions = (s2.where(F.col("_act").isNotNull() | F.col("_kill"))
               .select(F.col("id").alias("job_id"),
                       F.when(F.col("_kill"), F.when(F.col("_act") == "stop", "stop_fail").otherwise("fail"))
                       .otherwise(F.col("_act")).alias("action")))
    return {"queue": s2.where(~F.col("_kill")).drop("_act", "_kill"),
            "history": to_history(killed, F.col("update_time"), F.lit(FAIL)),
            "actions": actions}


def requeue_from_nodes(queue: DataFrame, node_ids: DataFrame, as_of) -> DataFrame:
    """Running jobs of expired nodes → pending; start, pid, node cleared."""
    n = node_ids.select(F.col("node_id").alias("_dead")).distinct()
    j = queue.join(n, queue.node_id == n._dead, "left")
    hit = (F.col("status") == RUNNING) & F.col("_dead").isNotNull()
    return _replace(j, status=F.when(hit, F.lit(PENDING)).otherwise(F.col("status")),
                    update_time=F.when(hit, ts(as_of)).otherwise(F.col("update_time")),
                    start_time=F.when(hit, F.lit(None)).otherwise(F.col("start_time")),
                    pid=F.when(hit, F.lit(None)).otherwise(F.col("pid")),
                    node_id=F.when(hit, F.lit(None)).otherwise(F.col("node_id"))).drop("_dead")


# ---------------------------------------------------------------- L9-L13 nodes
def _unregistered(c: str = "node_key_id") -> Column:
    # the reference tests ``not node.node_key_id``: NULL and 0 both count
    return F.coalesce(F.col(c), F.lit(0)) == 0


def node_sweep(nodes: DataFrame, as_of, timeout: int = NODE_TIMEOUT) -> dict[str, DataFrame]:
    """Alive nodes silent for ``timeout`` seconds go offline; unregistered
    ones are also marked deleted. Returns the nodes and the expired ids (L8)."""
    exp = (F.col("isalive") == 1) & (F.col("last_heartbeat") < _plus(ts(as_of), -timeout))
    n = nodes.withColumn("_exp", F.coalesce(exp, F.lit(False)))
    out = _replace(n, isalive=F.when(F.col("_exp"), F.lit(0)).otherwise(F.col("isalive")),
                   is_deleted=F.when(F.col("_exp") & _unregistered(), F.lit(True)).otherwise(F.col("is_deleted")))
    return {"nodes": out.drop("_exp"), "expired": n.where("_exp").select(F.col("id").alias("node_id"))}


def session_sweep(sessions: DataFrame, as_of, timeout: int = NODE_TIMEOUT) -> DataFrame:
    """Sessions whose last heartbeat is older than ``timeout`` are removed."""
    return sessions.where(~(F.col("last_heartbeat") < _plus(ts(as_of), -timeout)))


def login_decisions(attempts: DataFrame, nodes: DataFrame, sessions: DataFrame,
                    auth_enabled: bool = True, guard: int = SESSION_GUARD) -> DataFrame:
    """What each login attempt (attempt_id, node_id or NULL, ts) does:
    anonymous_disabled / create_node / not_found / conflict (the node's
    session was created less than ``guard`` seconds before) / replace (an
    older session is dropped) / new_session. A node's attempts are taken in
    order of time, then id, so a login sees the session of the one before it
    in the same batch. ``sessions`` are those before the batch; a node's
    existing one is its latest.

    Whether a login succeeds depends on the last one that did, so a node's
    attempts are read one after the other, sorted within a partition; the
    reader keeps one time per node, whatever their number."""
    last = sessions.groupBy("node_id").agg(F.max("create_at").alias("_last_session"))
    n = nodes.select(F.col("id").alias("_nid"))
    j = (attempts.join(n, attempts.node_id == n._nid, "left")
         .join(last.withColumnRenamed("node_id", "_snid"), F.col("node_id") == F.col("_snid"), "left"))
    anon = F.col("node_id").isNull()
    other = j.where(anon | F.col("_nid").isNull()).select("attempt_id", "node_id", (
        F.when(anon & F.lit(auth_enabled), "anonymous_disabled").when(anon, "create_node").otherwise("not_found")).alias("decision"))
    known = j.where(~anon & F.col("_nid").isNotNull()).select(
        "attempt_id", "node_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.unix_micros(F.col("_last_session").cast("timestamp")).alias("s"))

    def run(frames):
        node, created = None, None
        for f in frames:
            out = []
            for node_id, t, s in zip(f["node_id"], f["t"], f["s"]):
                if node_id != node:
                    node, created = node_id, None if s != s or s is None else int(s)
                if created is not None and created > t - guard * 1_000_000:
                    out.append("conflict")
                else:
                    out.append("new_session" if created is None else "replace")
                    created = int(t)
            yield f[["attempt_id", "node_id"]].assign(decision=out)

    parts = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (known.repartition(parts, "node_id").sortWithinPartitions("node_id", "t", "attempt_id")
            .mapInPandas(run, other.schema).unionByName(other))


def apply_heartbeats(nodes: DataFrame, beats: DataFrame) -> dict[str, DataFrame]:
    """Each node's latest beat in the batch. Unknown nodes and dead
    unregistered nodes are told they expired; the others come alive with
    last_heartbeat = their latest beat."""
    last = beats.groupBy("node_id").agg(F.max("ts").alias("last_beat"))
    n = nodes.select(F.col("id").alias("_nid"), F.col("isalive").alias("_alive"),
                     F.col("node_key_id").alias("_key"))
    j = last.join(n, last.node_id == n._nid, "left")
    reason = (F.when(F.col("_nid").isNull(), "unknown node")
              .when((F.col("_alive") == 0) & _unregistered("_key"), "dead unregistered"))
    outcome = j.select("node_id", "last_beat", reason.isNull().alias("accepted"), reason.alias("reason"))
    ok = outcome.where("accepted").select(F.col("node_id").alias("_ok"), "last_beat")
    nj = nodes.join(ok, nodes.id == ok._ok, "left")
    new_nodes = _replace(nj, last_heartbeat=F.coalesce("last_beat", "last_heartbeat"),
                         isalive=F.when(F.col("_ok").isNotNull(), F.lit(1)).otherwise(F.col("isalive"))
                         ).drop("_ok", "last_beat")
    return {"outcome": outcome, "nodes": new_nodes}


def apply_session_heartbeats(nodes: DataFrame, sessions: DataFrame, beats: DataFrame) -> dict[str, DataFrame]:
    """L12, session side: each session's latest beat in the batch. A session
    that is unknown, whose node is unknown, or whose node is dead and
    unregistered is told it expired; the others get it as last_heartbeat."""
    last = beats.groupBy("session_id").agg(F.max("ts").alias("last_beat"))
    s = sessions.select(F.col("id").alias("_sid"), F.col("node_id").alias("_snode"))
    n = nodes.select(F.col("id").alias("_nid"), F.col("isalive").alias("_alive"), F.col("node_key_id").alias("_key"))
    j = last.join(s, last.session_id == s._sid, "left").join(n, F.col("_snode") == F.col("_nid"), "left")
    reason = (F.when(F.col("_sid").isNull(), "unknown session").when(F.col("_nid").isNull(), "unknown node")
              .when((F.col("_alive") == 0) & _unregistered("_key"), "dead unregistered"))
    outcome = j.select("session_id", "last_beat", reason.isNull().alias("accepted"), reason.alias("reason"))
    ok = outcome.where("accepted").select(F.col("session_id").alias("_ok"), "last_beat")
    new = _replace(sessions.join(ok, sessions.id == ok._ok, "left"), last_heartbeat=F.coalesce("last_beat", "last_heartbeat"))
    return {"outcome": outcome, "sessions": new.drop("_ok", "last_beat")}


def resolve_node_keys(tokens: DataFrame, node_keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node token → node: unknown key is an error; an unused key and a
    key whose node is deleted give no node. ``can_register`` tells whether
    the key may still register a new node (unused, not yet taken)."""
    k = node_keys.select(F.col("key").alias("_key"), F.col("used_node_id").alias("_used"))
    n = nodes.select(F.col("id").alias("_nid"), F.col("is_deleted").alias("_del"))
    j = tokens.join(k, tokens.token == k._key, "left").join(n, F.col("_used") == F.col("_nid"), "left")
    outcome = (F.when(F.col("_key").isNull(), "key not found")
               .when(F.col("_used").isNull(), "unused")
               .when(F.col("_nid").isNull(), "node not found")
               .when(F.coalesce(F.col("_del"), F.lit(False)), "node deleted")
               .otherwise("ok"))
    return j.select("token", F.when(outcome == "ok", F.col("_nid")).alias("node_id"), outcome.alias("outcome"),
                    (F.col("_key").isNotNull() & F.col("_used").isNull()).alias("can_register"))


# ---------------------------------------------------------------- L14 webhook jobs
def webhook_job_transitions(webhook_jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Apply delivery events (start → 1, finish → 2 + log, fail → 3 +
    log, restart: running → pending) to webhook jobs, in time order.

    Only the last non-restart event and whether a restart follows it
    matter, so two decomposable aggregates per job replace a replay."""
    order = F.struct("ts", "event_id")
    nr = F.col("event") != "restart"
    agg = events.groupBy("webhook_job_id").agg(
        F.max_by(F.when(nr, F.struct("event", "log")), F.when(nr, order)).alias("_last"),
        F.max(F.when(nr, order)).alias("_last_at"),
        F.max(F.when(~nr, order)).alias("_restart_at"))
    j = webhook_jobs.join(agg, webhook_jobs.id == agg.webhook_job_id, "left")
    after = (F.when(F.col("_last.event") == "start", 1).when(F.col("_last.event") == "finish", 2)
             .when(F.col("_last.event") == "fail", 3).otherwise(F.col("status")))
    restarted = F.col("_restart_at").isNotNull() & (F.col("_last_at").isNull() | (F.col("_restart_at") > F.col("_last_at")))
    status = F.when(restarted & (after == 1), F.lit(0)).otherwise(after)
    log = F.when(F.col("_last.event").isin("finish", "fail") & F.col("_last.log").isNotNull(),
                 F.col("_last.log")).otherwise(F.col("log"))
    return _replace(j, status=status.cast("int"), log=log).drop("webhook_job_id", "_last", "_last_at", "_restart_at")


def add_webhook_jobs(webhook_jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """A pending webhook job for each finished job to deliver (job_id,
    spider_id, payload_url), numbered after the existing ones by job id."""
    top = webhook_jobs.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = row_number_within(finished.withColumn("_all", F.lit(0)), ["_all"], ["job_id"])
    new = numbered.select((top + F.col("rank")).cast("long").alias("id"), "job_id", "spider_id", "payload_url",
                          F.lit(PENDING).cast("int").alias("status"), F.lit(None).cast("string").alias("log"))
    return webhook_jobs.unionByName(new)


# ---------------------------------------------------------------- L15 settings form
def _last(rows: DataFrame, key: str, order_col: str) -> DataFrame:
    """The row of highest ``order_col`` of each key, by an aggregate."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order_col).alias("_r")).select("_r.*")


FORM_KEYS = ["concurrency", "timeout", "webhook_payload", "webhook_batch_size", "tag", "extra_requirements"]


def settings_upsert(settings: DataFrame, parameters: DataFrame, figures: DataFrame,
                    forms: DataFrame, order_col: str = "form_id") -> dict[str, DataFrame]:
    """Apply submitted settings forms, one after the other by ``order_col``:
    of a spider's forms the last one holds, and of its figures the last that
    is valid.

    Per form spider and key the first existing row (lowest id) is updated,
    else a row is added: concurrency '1' and timeout '3600' when missing,
    webhook fields '' when missing, tag / requirements stripped with blank →
    NULL. Parameters are replaced wholesale: keys trimmed, blank keys
    dropped, the last value of a repeated key wins. A figure is stored only
    if its text is one JSON value. New ids are max(id) + a deterministic offset.
    """
    valid = forms.where(F.col("figure_json").isNotNull() & json_variant(F.col("figure_json")).isNotNull())
    fj = valid.groupBy("spider_id").agg(F.max_by("figure_json", order_col).alias("_text"))
    given = _last(forms.select("spider_id", order_col, *FORM_KEYS), "spider_id", order_col)
    forms = _last(forms.select("spider_id", order_col, "param_keys", "param_values"), "spider_id", order_col)

    def blank_null(c):
        v = F.trim(F.col(c))
        return F.when(v == "", F.lit(None)).otherwise(v)

    # a spider's first rows side by side, so that forms meet them before they become a row a key
    kept = settings.where(F.col("setting_key").isin(*FORM_KEYS)).groupBy(F.col("spider_id").alias("_sid")).agg(
        *[F.min(F.when(F.col("setting_key") == k, F.col("id"))).alias(f"_first{i}") for i, k in enumerate(FORM_KEYS)])
    vals = given.join(kept, F.col("spider_id") == F.col("_sid"), "left").select("spider_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("k_no"), F.lit(k).alias("setting_key"), v.cast("string").alias("value"), F.col(f"_first{i}").alias("_first_id"))
        for i, (k, v) in enumerate([
            ("concurrency", F.coalesce("concurrency", F.lit("1"))),
            ("timeout", F.coalesce("timeout", F.lit("3600"))),
            ("webhook_payload", F.coalesce("webhook_payload", F.lit(""))),
            ("webhook_batch_size", F.coalesce("webhook_batch_size", F.lit(""))),
            ("tag", blank_null("tag")),
            ("extra_requirements", blank_null("extra_requirements"))])])))
    max_sid = settings.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    v = vals.withColumn("id", F.coalesce("_first_id", max_sid + 1 + F.col("spider_id") * len(FORM_KEYS) + F.col("k_no")))
    upd = v.select("id", F.col("value").alias("_new"), F.lit(True).alias("_hit"))
    # a matched row gets the form value even when that value is NULL
    new_settings = (settings.join(upd, "id", "left").withColumn("value", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("value")))
                    .select(*settings.columns)
                    .unionByName(v.where(F.col("_first_id").isNull()).select(*settings.columns)))
    # parameters: replaced wholesale for the form spiders
    kv = forms.select("spider_id", F.posexplode(F.arrays_zip("param_keys", "param_values")).alias("pos", "kv"))
    kv = kv.select("spider_id", "pos", F.trim(F.col("kv.param_keys")).alias("parameter_key"),
                   F.col("kv.param_values").alias("value")).where(F.col("parameter_key") != "")
    kv = kv.groupBy("spider_id", "parameter_key").agg(F.max_by("value", "pos").alias("value"),
                                                      F.min("pos").alias("_pos"))
    max_pid = parameters.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    # a spider's new ids lie in a range of its own, as long as the longest form
    width = forms.select(F.coalesce(F.max(F.size("param_keys")), F.lit(0)).cast("long") + 1).scalar()
    new_params = (parameters.join(forms.select("spider_id"), "spider_id", "left_anti")
                  .unionByName(kv.select((max_pid + 1 + F.col("spider_id") * width + F.col("_pos")).alias("id"),
                                         "spider_id", "parameter_key", "value")))
    ffirst = figures.groupBy("spider_id").agg(F.min("id").alias("id"))
    max_fid = figures.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fj = fj.join(ffirst, "spider_id", "left").withColumn("id", F.coalesce("id", max_fid + 1 + F.col("spider_id")))
    new_figs = (figures.join(fj.select("id"), "id", "left_anti")
                .unionByName(fj.select("id", "spider_id", F.col("_text").alias("text"))))
    return {"settings": new_settings, "parameters": new_params, "figures": new_figs}


# ---------------------------------------------------------------- L15 webhook address
def webhook_urls(settings: DataFrame, spider_ids: DataFrame) -> DataFrame:
    """L15 get: the webhook address of each asked spider that has one set."""
    url = dedupe_eav(settings.where(F.col("setting_key") == "webhook_payload"), "spider_id", "setting_key")
    return url.join(spider_ids.select("spider_id"), "spider_id", "left_semi").select("spider_id", F.col("value").alias("payload_url"))


def put_webhook_urls(settings: DataFrame, urls: DataFrame, order_col: str = "put_id") -> DataFrame:
    """L15 put: (put_id, spider_id, payload_url) into the spider's first webhook
    row, or a new one (id: the highest + 1 + spider id). Of several puts of a
    spider the last one by ``order_col`` holds."""
    urls = _last(urls, "spider_id", order_col)
    first = settings.where(F.col("setting_key") == "webhook_payload").groupBy("spider_id").agg(F.min("id").alias("_first"))
    top = settings.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    u = urls.join(first, "spider_id", "left").select(
        F.coalesce("_first", top + 1 + F.col("spider_id")).alias("id"), "spider_id",
        F.lit("webhook_payload").alias("setting_key"), F.col("payload_url").alias("value"))
    return settings.join(u.select("id"), "id", "left_anti").select(*settings.columns).unionByName(u)


def delete_webhook_urls(settings: DataFrame, spider_ids: DataFrame) -> DataFrame:
    """L15 delete: no webhook rows are left of the given spiders."""
    gone = settings.where(F.col("setting_key") == "webhook_payload").join(spider_ids.select("spider_id"), "spider_id", "left_semi")
    return settings.join(gone.select("id"), "id", "left_anti")
