"""Streams over several micro-batches, in and out of order."""

import datetime as dt

from pyspark.sql import functions as F

from crawlgrid.functions.cron import cron_fires
from crawlgrid.operators.lifecycle import enqueue
from crawlgrid.session import scratch_dir
from crawlgrid.sources import files
from crawlgrid.sources.catalog import SCHEMAS
from crawlgrid.streaming import feeds, jobs, liveness
from crawlgrid.streaming.runner import StreamCounts, run_append, run_batches

T0 = dt.datetime(2024, 1, 1)


def at(clock):
    h, m, s = map(int, clock.split(":"))
    return T0.replace(hour=h, minute=m, second=s)


def feed(spark, schema, *batches):
    """A stream that gets each batch as one micro-batch."""
    path = scratch_dir(spark, "test-feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


BEAT = "node_id long, ts timestamp_ntz"
END = (9, at("23:00:00"))


def states(spark, *batches):
    got = run_append(liveness.node_state_stream(feed(spark, BEAT, *batches, [END]), 60, "1 hour"), "t").collect()
    return sorted((r.event, r.at) for r in got if r.node_id == 1)


def test_node_states_with_a_late_beat(spark):
    want = [("offline", at("00:11:40")), ("online", at("00:09:30"))]
    beats = [(1, at("00:10:00")), (1, at("00:09:30")), (1, at("00:10:40"))]
    assert states(spark, *[[b] for b in beats]) == want
    assert states(spark, beats) == want
    assert states(spark, beats[2:], beats[:2]) == want


def test_node_states_gap_between_batches(spark):
    want = [("offline", at("00:11:00")), ("offline", at("00:13:00")), ("online", at("00:10:00")), ("online", at("00:12:00"))]
    assert states(spark, [(1, at("00:10:00"))], [(1, at("00:12:00"))]) == want


EVENT = "job_id string, spider_id long, kind string, ts timestamp_ntz"
LAST = ("other", 9, "update", at("23:00:00"))
SETTINGS = "id long, spider_id long, setting_key string, value string"


def actions(spark, *batches, timeout="30"):
    settings = spark.createDataFrame([(1, 1, "timeout", timeout)], SETTINGS)
    got = run_append(jobs.job_timeout_stream(feed(spark, EVENT, *batches, [LAST]), settings, "10 minutes"), "t").collect()
    return sorted((r.at, r.action) for r in got if r.job_id == "j")


def test_stopped_job_is_failed_despite_updates(spark):
    want = [(at("01:00:30"), "stop"), (at("01:02:00"), "fail")]
    start, update = ("j", 1, "start", at("01:00:00")), ("j", 1, "update", at("01:01:20"))
    # the mark between the two passes the stop, so the update comes while stopping
    mark = ("other", 9, "update", at("01:11:00"))
    assert actions(spark, [start], [mark], [update]) == want
    assert actions(spark, [start], [update]) == want
    assert actions(spark, [start, update]) == want
    assert actions(spark, [start]) == want


def test_silent_job_is_requeued_between_updates(spark):
    start = ("j", 1, "start", at("01:00:00"))
    ups = [("j", 1, "update", at(c)) for c in ("01:00:50", "01:01:40", "01:05:00")]
    want = [(at("01:02:40"), "requeue")]
    for cut in ([[start, *ups]], [[u] for u in [start, *ups]], [ups, [start]]):
        assert actions(spark, *cut, timeout="3600") == want


def test_cron_fires_between_batches(spark):
    triggers = spark.createDataFrame([(1, 1, "*/5 * * * *")], "id long, spider_id long, cron_pattern string")
    spiders = spark.createDataFrame([(1, 1, "s")], "id long, project_id long, name string")
    projects = spark.createDataFrame([(1, "p")], "id long, name string")
    ticks = [[("00:00:00",), ("00:10:00",)], [("00:20:00",), ("00:30:00",)], [("00:15:00",)], [("00:31:00",)]]
    clock = feed(spark, "ts timestamp_ntz", *[[(at(c),) for (c,) in b] for b in ticks])
    settings = spark.createDataFrame([(1, 1, "tag", "t")], SETTINGS)
    ends = scratch_dir(spark, "ends")
    fn = feeds.cron_fire_batches(triggers, spiders, projects, settings, ends)
    out = run_batches(clock, "t", fn)
    fires = sorted(r.fire_time for r in out.collect())
    assert fires == [at(f"00:{m:02d}:00") for m in range(0, 31, 5)]
    assert out.select("id").distinct().count() == len(fires)
    assert out.drop("batch_id").columns == [f.name for f in SCHEMAS["spider_execution_queue"].fields]
    assert {(r.tag, r.status, r.project_name, r.spider_name, r.update_time == r.fire_time) for r in out.collect()} == {("t", 0, "p", "s", True)}
    # fired in one go: F2, then L1
    requests = cron_fires(triggers, "2024-01-01 00:00:00", "2024-01-01 00:31:00").select(
        F.concat_ws("@", F.col("id").cast("string"), F.col("fire_time").cast("string")).alias("req_key"), "spider_id", F.lit(None).alias("settings"))
    assert {r.id for r in enqueue(requests, spiders, projects, settings, "2024-01-01").collect()} == {r.id for r in out.collect()}
    # batch 1 again: its own ids
    again = fn(spark.createDataFrame([(at(c),) for (c,) in ticks[1]], "ts timestamp_ntz"), 1)
    assert {r.id for r in again.collect()} == {r.id for r in out.where("batch_id = 1").collect()}


QUEUE = "id string, node_id long, status int"
REPORT = "completion_id long, job_id string, node_id long, status string, ts timestamp_ntz"


def test_first_valid_completion_wins(spark):
    queue = spark.createDataFrame([("j", 5, 1), ("k", 5, 1), ("late", 5, 1), ("end", 5, 1)], QUEUE)
    batches = [[(1, "j", 6, "success", at("01:00:00")), (2, "k", 5, "nonsense", at("01:00:00"))],
               [(3, "j", 5, "success", at("01:00:30")), (4, "j", 5, "fail", at("01:00:31"))],
               [(5, "j", 5, "fail", at("01:20:00")), (6, "k", 5, "fail", at("01:30:00"))],
               [(7, "k", None, "success", at("01:29:59")), (8, "j", 5, "fail", at("01:00:30"))],  # out of order
               [(9, "end", 5, "success", at("23:00:00"))], [(11, "end", 5, "fail", at("23:00:01"))], [(10, "late", 5, "success", at("21:59:00"))]]
    for cut in (batches, [sum(batches[:4], []), *batches[4:]], [batches[3], *batches[:3], *batches[4:]]):
        got = run_append(jobs.completion_stream(feed(spark, REPORT, *cut), queue), "t").collect()
        assert sorted((r.completion_id, r.node_id, r.status_code) for r in got) == [(3, 5, 2), (7, None, 2)]  # the batch operator's answer


def test_settled_jobs_leave_the_state(spark):
    queue = spark.createDataFrame([(f"j{k}", 5, 1) for k in range(30)], QUEUE)
    batches = [[(10 * h + k, f"j{10 * h + k}", 5, "success", at(f"0{3 * h + 1}:00:00")) for k in range(10)] for h in range(3)]
    batches += [[(99, "j0", 5, "fail", at("20:00:00"))]]
    state = []
    for keep in (1800, 30 * 86_400):
        with StreamCounts(spark) as counts:
            got = run_append(jobs.completion_stream(feed(spark, REPORT, *batches), queue, keep_seconds=keep), "t5").collect()
        state.append(counts.state["t5"])
        assert {r.completion_id for r in got} == set(range(30))
    assert state[0] <= 4 < 30 <= state[1]  # the last report alone; every job ever settled


def test_adoption_is_kept(spark):
    queue = spark.createDataFrame([("j", None, 1), ("o", 5, 1), ("w", None, 0), ("end", None, 1)], QUEUE)
    rep = "node_id long, job_id string, ts timestamp_ntz"
    batches = [[(2, "j", at("01:00:00")), (5, "o", at("01:00:00"))], [(3, "j", at("01:01:00")), (4, "x", at("01:01:00"))],
               [(2, "j", at("01:02:00")), (6, "o", at("01:02:00")), (7, "w", at("01:03:00"))]]
    end = [(9, "end", at("23:00:00"))]
    for cut in (batches, [sum(batches, [])], batches[::-1]):
        got = run_append(jobs.running_report_stream(feed(spark, rep, *cut, end), queue), "t").collect()
        assert sorted((r.node_id, r.job_id, r.reason) for r in got) == [
            (3, "j", "other node"), (4, "x", "job unknown"), (6, "o", "other node"), (7, "w", "not running")]


def test_adoptions_are_forgotten(spark):
    queue = spark.createDataFrame([("j", None, 1), ("end", None, 1)], QUEUE)
    rep = "node_id long, job_id string, ts timestamp_ntz"
    cut = [[(2, "j", at("01:00:00"))], [(3, "j", at("05:00:00"))], [(9, "end", at("20:00:00"))], [(9, "end", at("23:00:00"))]]
    for keep, want in ((3600, []), (86_400, [3])):
        with StreamCounts(spark) as counts:
            got = run_append(jobs.running_report_stream(feed(spark, rep, *cut), queue, keep_seconds=keep), "t8").collect()
        assert [r.node_id for r in got] == want
        assert counts.late["t8"] == 0


def test_late_rows_are_counted(spark):
    # a batch's rows are held against the watermark that the batch before it began with
    beats = [[(1, at("05:00:00")), (1, at("04:10:00"))], [(1, at("05:00:01"))], [(1, at("04:30:00")), (2, at("03:59:00")), (1, at("01:00:00"))],
             [(3, at("23:00:00"))], [(3, at("23:00:01"))], [(3, at("10:00:00"))]]
    for stream in (lambda f: liveness.node_state_stream(f, 60, "1 hour"), lambda f: liveness.node_liveness_stream(f, "60 seconds", "1 hour")):
        with StreamCounts(spark) as counts:
            run_append(stream(feed(spark, BEAT, *beats)), "late")
        assert counts.late["late"] == 3 and counts.rows["late"] == 9
        seen = [m for _, name, m in counts.observed["late"] if name == "arrived"]
        assert sum(m["rows"] for m in seen) == 9 and min(m["earliest"] for m in seen if m["earliest"]).hour == 1
    events = [[("j", 1, "start", at("05:00:00"))], [("o", 1, "update", at("05:00:01"))], [("j", 1, "update", at("05:00:30")), ("k", 1, "start", at("04:00:00"))], [LAST]]
    settings = spark.createDataFrame([(1, 1, "timeout", "30")], SETTINGS)
    with StreamCounts(spark) as counts:
        run_append(jobs.job_timeout_stream(feed(spark, EVENT, *events), settings, "10 minutes"), "late3")
    assert counts.late["late3"] == 1


def test_waiting_beats_are_not_rewritten(spark):
    """A node with very many beats that wait: each batch writes its own only."""
    n, cut = 1_200, []
    for k in range(4):
        cut.append([(1, T0 + dt.timedelta(milliseconds=100 * (k * n // 4 + i))) for i in range(n // 4)])
    with StreamCounts(spark) as counts:
        got = run_append(liveness.node_state_stream(feed(spark, BEAT, *cut, [END]), 60, "1 hour"), "many").collect()
    assert sorted((r.event, r.at) for r in got if r.node_id == 1) == [("offline", cut[-1][-1][1] + dt.timedelta(seconds=60)), ("online", T0)]
    assert counts.updated["many"][0] <= 2.1 * n / 4 and max(counts.updated["many"][1:4]) <= 2.1 * n / 4


def ingested(spark, store):
    items = sorted((r.job_id, r.line_no, r.raw, r.bad) for r in feeds.ingested_items(spark, store).collect())
    counts = {r.job_id: (r.lines, r.bad_lines) for r in feeds.ingested_counts(spark, store).collect()}
    return items, counts


def test_item_files_arrive(spark, tmp_path):
    """Items and counts equal the batch reader's, whatever the micro-batches and the files' lengths."""
    folder = tmp_path / "items" / "proj" / "spid"
    folder.mkdir(parents=True)
    for k in range(3):
        (folder / f"job{k}.jl").write_text('{"a": 1}\n' * (k + 1) + "bad")
    (folder / "none.jl").write_text("")
    want = sorted((r.job_id, r.line_no, r.raw, r.bad) for r in files.read_job_items(spark, str(tmp_path)).collect())
    assert len(want) == 9
    for most, small in ((1, 10**6), (100, 10**6), (2, 15)):
        store = scratch_dir(spark, "ingest")
        run_batches(feeds.item_file_stream(spark, str(tmp_path), most), "t", feeds.item_ingest(store, small))
        assert ingested(spark, store) == (want, {"job0": (2, 1), "job1": (3, 1), "job2": (4, 1)})


def test_replayed_ingest_batch_changes_nothing(spark, tmp_path):
    folder = tmp_path / "items" / "proj" / "spid"
    folder.mkdir(parents=True)
    (folder / "a.jl").write_text('{"a": 1}\n{"a": 2}\n')
    (folder / "b.jl").write_text('{"b": 1}\n')
    store = scratch_dir(spark, "ingest")
    sink = feeds.item_ingest(store)
    batch = lambda name: spark.read.format("binaryFile").load(str(folder / name)).select("path", "length", "content")
    sink(batch("a.jl"), 0)
    sink(batch("b.jl"), 1)
    once = ingested(spark, store)
    sink(batch("b.jl"), 1)
    sink(batch("a.jl"), 0)
    assert ingested(spark, store) == once == ([("a", 1, '{"a": 1}', False), ("a", 2, '{"a": 2}', False), ("b", 1, '{"b": 1}', False)], {"a": (2, 0), "b": (1, 0)})
    (folder / "a.jl").write_text('{"a": 3}\n')  # the job's file comes again
    sink(batch("a.jl"), 2)
    assert ingested(spark, store) == ([("a", 1, '{"a": 3}', False), ("b", 1, '{"b": 1}', False)], {"a": (1, 0), "b": (1, 0)})


def test_packed_item_files_arrive(spark, tmp_path):
    items = spark.range(60).select(F.lit("p").alias("project"), F.lit("s").alias("spider"), F.concat(F.lit("j"), (F.col("id") % 20).cast("string")).alias("job_id"),
                                   F.col("id").alias("k"), F.when(F.col("id") == 5, F.repeat(F.lit("x"), files.PACKED_FILE)).otherwise(F.lit('{"a": 1}')).alias("raw"))
    files.write_job_files(items, str(tmp_path), "raw", "items", order_col="k", packed=True)
    assert [f.name for f in tmp_path.rglob("*.jl")] == ["j5.jl"]
    want = sorted((r.job_id, r.line_no, r.raw, r.bad) for r in files.read_job_items(spark, str(tmp_path), fmt="packed").collect())
    store = scratch_dir(spark, "ingest")
    run_batches(feeds.item_file_stream(spark, str(tmp_path), 100, max_packs=1), "t", feeds.item_ingest(store))
    items, counts = ingested(spark, store)
    assert items == want and len(want) == 60
    assert counts == {f"j{k}": (3, int(k == 5)) for k in range(20)}


def test_a_batch_of_beats_is_one_entry(spark):
    """Beats that arrive together wait together: state rows follow nodes and batches, not beats."""
    cut = [[(1, T0 + dt.timedelta(seconds=7200 * b + 30 * i)) for i in range(100)] for b in range(2)]
    with StreamCounts(spark) as counts:
        got = run_append(liveness.node_state_stream(feed(spark, BEAT, *cut, [END]), 60, "1 hour"), "chunks").collect()
    assert sorted(r.event for r in got if r.node_id == 1) == ["offline", "offline", "online", "online"]
    assert max(counts.updated["chunks"][:2]) <= 10


def test_jobs_share_state_rows(spark, monkeypatch):
    """Very many jobs are handled by the bucket, with each job's own result."""
    from crawlgrid.streaming import runner
    monkeypatch.setattr(runner, "BUCKETS", 4)
    settings = spark.createDataFrame([(1, 1, "timeout", "30")], SETTINGS)
    jobs_ = [(f"j{k}", 1 + k % 2, "start", at("01:00:00") + dt.timedelta(seconds=k)) for k in range(60)]
    with StreamCounts(spark) as counts:
        got = run_append(jobs.job_timeout_stream(feed(spark, EVENT, jobs_[:30], jobs_[30:], [LAST]), settings, "10 minutes"), "shared").collect()
    want = []
    for job, spider, _, t in jobs_:
        want += [(job, "stop", t + dt.timedelta(seconds=30)), (job, "fail", t + dt.timedelta(seconds=120))] if spider == 1 else [(job, "requeue", t + dt.timedelta(seconds=60))]
    assert sorted((r.job_id, r.action, r.at) for r in got) == sorted(want)
    assert max(counts.updated["shared"]) <= 4
    queue = spark.createDataFrame([(f"j{k}", 5, 1) for k in range(40)], QUEUE)
    reports = [(k + 100 * t, f"j{k}", 5, "success", at(f"0{1 + t}:00:00")) for t in (1, 0) for k in range(40)]
    with StreamCounts(spark) as counts:
        got = run_append(jobs.completion_stream(feed(spark, REPORT, reports, [(999, "j0", 5, "fail", at("23:00:00"))]), queue), "shared5").collect()
    assert sorted(r.completion_id for r in got) == list(range(40))
    assert max(counts.updated["shared5"]) <= 4


def test_triggers_meet_their_spiders_before_they_fire(spark):
    spiders = spark.createDataFrame([(1, 1, "s"), (2, 1, "t")], "id long, project_id long, name string")
    projects = spark.createDataFrame([(1, "p")], "id long, name string")
    settings = spark.createDataFrame([(1, 1, "tag", "t")], SETTINGS)
    requests = spark.createDataFrame([("a", 1, None), ("b", 2, None)], "req_key string, spider_id long, settings string")
    met = []

    def twice(j):
        met.append(set(j.columns))
        return j.withColumn("n", F.explode(F.array(F.lit("1"), F.lit("2")))).withColumn("req_key", F.concat("req_key", "n"))

    got = enqueue(requests, spiders, projects, settings, "2024-01-01", twice)
    plain = spark.createDataFrame([(k + n, s, None) for k, s in (("a", 1), ("b", 2)) for n in "12"], requests.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, enqueue(plain, spiders, projects, settings, "2024-01-01").collect()))
    assert {"spider_name", "project_name", "tag"} <= met[0]
