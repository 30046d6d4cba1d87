"""X3 job timeouts by timers, X5 completions, X8 running reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crawlgrid.constants import DEFAULT_JOB_TIMEOUT, KILL_GRACE, UPDATE_GRACE
from crawlgrid.operators.aggregates import dedupe_eav
from crawlgrid.operators.lookup import completable
from crawlgrid.streaming.runner import EVENT_TIME, bucketed_state, event_time, millis, timed_state

ACTIONS_OUT = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("action", T.StringType()), T.StructField("at", T.TimestampType())])
IDLE, RUNNING, STOPPING = 0, 1, 2


def job_events(queue: DataFrame) -> DataFrame:
    """Running queue rows as events: ('start', start_time), ('update', update_time)."""
    r = queue.where(F.col("status") == 1)
    return r.select("id", "spider_id", F.explode(F.array(
        F.struct(F.lit("start").alias("kind"), F.col("start_time").alias("ts")),
        F.struct(F.lit("update").alias("kind"), F.col("update_time").alias("ts")))).alias("e")).select(
        F.col("id").alias("job_id"), "spider_id", "e.kind", "e.ts")


def _events(frame: pd.DataFrame) -> Iterator[tuple]:
    return zip(millis(frame[EVENT_TIME]).tolist(), (k != "start" for k in frame["kind"]), (int(t) * 1000 for t in frame["timeout_s"]))


def job_timeouts(job_id, held: tuple | None, new: Sequence[tuple], mark: int) -> tuple[tuple | None, int | None, list[tuple]]:
    """Events (ms, is update, timeout) wait until the watermark has passed them;
    all that it has passed are then taken in order of time, deadlines between
    them. What is held is the job and the events that wait; its deadline the
    next time at which anything can fall due."""
    phase, start, last, timeout, stopped, waiting = held or (IDLE, 0, 0, 0, 0, ())
    events = {(ms, is_update): given for ms, is_update, given in (*waiting, *new)}
    rows = []

    def due():
        if phase == RUNNING:
            stop_at, requeue_at = start + timeout, last + UPDATE_GRACE * 1000
            return (stop_at, "stop") if stop_at <= requeue_at else (requeue_at, "requeue")
        return (max(stopped, start + KILL_GRACE * 1000), "fail") if phase == STOPPING else None

    def act(before):
        nonlocal phase, stopped
        while (d := due()) and d[0] < before:
            rows.append((job_id, d[1], pd.Timestamp(d[0], unit="ms")))
            phase, stopped = (STOPPING, d[0]) if d[1] == "stop" else (IDLE, 0)

    before = None
    for at, is_update in sorted(events):  # a start before an update of its time
        if at >= mark:
            break
        if at != before:  # deadlines of an event's own time come after it
            act(at)
            before = at
        given = events.pop((at, is_update))
        if phase == RUNNING:
            last = at
        elif phase == IDLE and not is_update:
            phase, start, last, timeout = RUNNING, at, at, given
    act(mark)
    following = due()
    waits = [*(ms for ms, _ in events), *([following[0]] if following else [])]
    if not waits:
        return None, None, rows
    return (phase, start, last, timeout, stopped, tuple((*e, given) for e, given in events.items())), min(waits), rows


def job_timeout_stream(events: DataFrame, settings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The L7 sweep driven by event-time timers instead of polling.

    A running job is stopped at start + timeout, or requeued once more than
    60 s have passed since its last update, whichever is first; a stopped job
    is failed 120 s after its start (at the stop, if that is later). Events
    are taken in order of time once the watermark has passed them, so the
    actions don't depend on how the feed is cut into micro-batches. Updates of
    a job that isn't running (stopping, requeued, not started) change nothing.
    ``settings`` is static (stream-static join for the timeout setting).
    """
    to = (dedupe_eav(settings.where(F.col("setting_key") == "timeout"), "spider_id", "setting_key")
          .select("spider_id", F.trim("value").try_cast("long").alias("timeout_s")))
    e = (event_time(events, "ts", delay).join(to, "spider_id", "left")
         .select("job_id", "kind", EVENT_TIME,
                 F.coalesce("timeout_s", F.lit(DEFAULT_JOB_TIMEOUT)).alias("timeout_s")))
    return (bucketed_state(e, "job_id", _events, job_timeouts, ACTIONS_OUT)
            .select("job_id", "action", F.col("at").cast("timestamp_ntz").alias("at")))


def first_reports(schema: T.StructType, tie: str, keep_ms: int) -> tuple[Callable, Callable]:
    """Of each key the row of least (ts, tie), given out once the watermark has
    passed it: no earlier one can arrive then. A mark that the key is settled
    stays for ``keep_ms`` more and goes with its deadline. The functions of
    ``bucketed_state``; held are the row that waits and its time, or no row and
    the time at which the key was settled."""
    names = schema.names
    at, by = names.index("ts"), names.index(tie)
    whole = [isinstance(f.dataType, T.IntegralType) for f in schema.fields]

    def plain(value, integer):
        """pandas keeps integers beside nulls as floats."""
        if pd.isna(value):
            return None
        return int(value) if integer else value

    def rows_of(frame: pd.DataFrame) -> Iterator[tuple]:
        return zip(*([plain(x, w) for x in frame[n].tolist()] for n, w in zip(names, whole)))

    def step(_, held, new, mark):
        best, ms = held or (None, None)
        if held is None or best is not None:
            best = min((*new, *([] if best is None else [best])), key=lambda r: (r[at] is None, r[at], r[by] is None, r[by]))
            ms = int(pd.Timestamp(best[at]).value // 1_000_000)
            if ms >= mark:
                return (best, ms), ms, []
        out = [] if best is None else [best]
        return ((None, ms), ms + keep_ms, out) if ms + keep_ms >= mark else (None, None, out)

    return rows_of, step


KEEP = 7 * 86_400  # seconds that a settled job is remembered


def completion_stream(completions: DataFrame, queue: DataFrame, delay: str = "1 hour", keep_seconds: int = KEEP) -> DataFrame:
    """Accept each job's first valid completion. Reports are checked
    against the static queue first (P5), so one from a wrong node or with an
    invalid status doesn't use up the job; of the valid ones the earliest (by
    time, then id) wins, whatever the order in which they come: it is accepted
    when the watermark has passed it. A mark keeps further reports out for
    ``keep_seconds`` after it; by then the job has left the queue, so that
    the state holds the jobs of that time only."""
    ok = completable(event_time(completions, "ts", delay), queue).where("accepted")
    schema = ok.drop(EVENT_TIME).schema
    out = bucketed_state(ok, "job_id", *first_reports(schema, "completion_id", keep_seconds * 1000), schema)
    return out.select(*schema.names)


class Adoptions(StatefulProcessor):
    """A job without an owner is adopted by its first reporter. Reports wait as
    entries of a map until the watermark has passed them; the owner is
    forgotten ``keep_ms`` after the job's last report."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reports = handle.getMapState("reports", "ms long", "rows array<struct<us:long,node_id:long,running:boolean>>")
        self.owner = handle.getValueState("owner", "node_id long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list] = {}
        for frame in rows:
            us = frame["ts"].astype("datetime64[us]").astype("int64")
            for u, node, status in zip(us.tolist(), frame["node_id"], frame["status"]):
                new.setdefault(u // 1000, []).append((u, int(node), bool(status == 1)))
        for ms, got in new.items():
            if self.reports.containsKey((ms,)):
                got = [tuple(r) for r in self.reports.getValue((ms,))[0]] + got
            self.reports.updateValue((ms,), (got,))
            self.handle.registerTimer(ms + 1)
            self.handle.registerTimer(ms + 1 + self.keep_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() - 1
        owner, last = self.owner.get() if self.owner.exists() else (None, None)
        if not self.reports.containsKey((at,)):
            if last is not None and at >= last + self.keep_ms:
                self.owner.clear()
            return
        rows = []
        for _, node, running in sorted(tuple(r) for r in self.reports.getValue((at,))[0]):
            owner = node if owner is None else owner
            reason = "other node" if node != owner else "" if running else "not running"
            if reason:
                rows.append((node, key[0], reason))
        self.reports.removeKey((at,))
        self.owner.update((owner, at))
        if rows:
            yield pd.DataFrame(rows, columns=["node_id", "job_id", "reason"])

    def close(self) -> None:
        pass


def running_report_stream(reports: DataFrame, queue: DataFrame, delay: str = "1 hour", keep_seconds: int = KEEP) -> DataFrame:
    """The J5 kill list of running-job reports as they arrive. A job of the
    queue without an owner is adopted by its first reporter (by time, then
    node): its reports are judged once the watermark has passed them, so the
    order in which they come doesn't matter; the adoption is kept for
    ``keep_seconds`` after the job's last report. Reports of owned or unknown
    jobs need no state and are judged at once."""
    q = queue.select(F.col("id").alias("job_id"), F.col("node_id").alias("_owner"), F.col("status").alias("_status"))
    j = event_time(reports, "ts", delay).join(q, "job_id", "left")
    free = j.where(F.col("_status").isNotNull() & F.col("_owner").isNull()).select("job_id", "node_id", "ts", F.col("_status").alias("status"), EVENT_TIME)
    adopted = timed_state(free, "job_id", Adoptions(keep_seconds * 1000), "node_id long, job_id string, reason string")
    reason = (F.when(F.col("_status").isNull(), F.lit("job unknown"))
              .when(F.col("_owner") != F.col("node_id"), F.lit("other node"))
              .when(F.col("_status") != 1, F.lit("not running")))
    known = (j.where(F.col("_status").isNull() | F.col("_owner").isNotNull())
             .select(F.col("node_id").cast("long").alias("node_id"), "job_id", reason.alias("reason")).where(F.col("reason").isNotNull()))
    return known.unionByName(adopted)
