"""Job files: exact line numbers across splits, both server layouts, invariants."""

import pytest
from pyspark.sql import functions as F

from crawlgrid.operators import history as T
from crawlgrid.operators import logs as L
from crawlgrid.sources import files as S
from crawlgrid.sources.adapters import DriverTables
from crawlgrid.streaming import liveness
from crawlgrid.streaming.runner import run_append


def test_line_numbers_exact_over_many_splits(spark, tmp_path):
    p = tmp_path / "logs" / "proj" / "spid"
    p.mkdir(parents=True)
    n = 20000
    (p / "job1.log").write_text("".join(f"line {i}\n" for i in range(1, n + 1)))
    (p / "job2.log").write_text("line 1\nline 2")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        for small in (1000, S.SMALL_FILE):  # split by bytes, and as a whole
            df = S.read_job_logs(spark, str(tmp_path), small_file=small)
            if small == 1000:
                assert S.long_lines(spark, str(tmp_path), "*.log", small).select("line").rdd.getNumPartitions() > 5
            bad = df.where(F.col("line") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count()
            assert bad == 0 and df.count() == n + 2
            assert df.select("job_id", "line_no").distinct().count() == n + 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_many_small_files_are_packed(spark, tmp_path):
    """15,000 files of one job each: a folder a spider, few tasks."""
    n = 15_000
    jobs = spark.range(n).select(F.lit("p").alias("project"), F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("spider"),
                                 F.concat(F.lit("j"), F.col("id").cast("string")).alias("job_id"), F.explode(F.sequence(F.lit(1), F.col("id") % 3 + 1)).alias("k"))
    items = jobs.withColumn("raw", F.format_string('{"job": "%s", "k": %d}', "job_id", "k"))
    manifest = S.write_job_files(items, str(tmp_path), "raw", "items", order_col="k")
    assert manifest.count() == n and manifest.agg(F.sum("lines")).first()[0] == 2 * n
    assert sum(1 for _ in (tmp_path / "items" / "p").iterdir()) == 50
    got = S.read_job_items(spark, str(tmp_path))
    assert S.whole_files(spark, str(tmp_path), "*.jl").rdd.getNumPartitions() < 60
    assert got.count() == 2 * n
    wrong = got.where((F.try_variant_get("item", "$.k", "bigint") != F.col("line_no")) | (F.try_variant_get("item", "$.job", "string") != F.col("job_id")))
    assert wrong.isEmpty()
    again = S.write_job_files(items.where("job_id = 'j7'").limit(1), str(tmp_path), "raw", "items")
    assert again.count() == 1  # a job's file is replaced, the others stay
    assert S.read_job_items(spark, str(tmp_path)).count() == 2 * n - 1
    assert not [f for f in (tmp_path / "items" / "p" / "s7").iterdir() if f.name.startswith(".j")]


def items_of(spark, root, **options):
    return sorted((r.project, r.job_id, r.line_no, r.bad, r.item and r.item.toPython()) for r in S.read_job_items(spark, str(root), **options).collect())


def test_items_in_both_layouts(spark, tmp_path):
    v1 = tmp_path / "items" / "proj" / "spid"
    v1.mkdir(parents=True)
    (v1 / "a1.jl").write_text('{"x": 1}\n\n{"y": {"z": 2}}\n')
    (v1 / "none.jl").write_text("")
    v2 = tmp_path / "projects" / "7" / "spiders" / "spid" / "jobs" / "b2"
    v2.mkdir(parents=True)
    (v2 / "items.jl").write_text('{"x": 3}\n[1]\n')
    want = [("7", "b2", 1, False, {"x": 3}), ("7", "b2", 2, True, None), ("proj", "a1", 1, False, {"x": 1}),
            ("proj", "a1", 2, True, None), ("proj", "a1", 3, False, {"y": {"z": 2}})]
    assert items_of(spark, tmp_path) == items_of(spark, tmp_path, small_file=0) == want


LINES = {'{"a": 1}': True, '  {"a": {"b": [1.5, true, null, "x"]}} ': True, '{"a": 1, "a": 2}': True, "{}": True, '{"a": 1}\r': True,
         '{"a": 1} x': False, '{"a": 1}{"b": 2}': False, '{"a": 1},{"b": 2}': False, '{"a": 1},"b":{"c": 2}': False, '{"a": 1}],[{"b": 2}': False,
         "{'a': 1}": False, "[1]": False, "3": False, "null": False, '"x"': False, "": False, " ": False, '{"a": 1': False, '{"a": NaN}': False, "{a: 1}": False}


def test_item_lines_are_strict(spark):
    rows = spark.createDataFrame(list(LINES.items()), "raw string, good boolean")
    for r in rows.select("*", S.item_variant(F.col("raw")).alias("v"), S.item_object(F.col("raw")).alias("m")).collect():
        assert (r.v is not None) == (r.m is not None) == r.good, r.raw


def test_items_keep_their_types(spark):
    import decimal
    raw = '{"n": 1, "f": 1.5, "b": true, "z": null, "s": "1", "o": {"l": [1, "x", false], "big": 12345678901234567890}}'
    got = S.parse_items(spark.createDataFrame([(raw,)], "raw string"))
    typed = got.select(F.schema_of_variant("item").alias("t"), F.try_variant_get("item", "$.o.l[2]", "boolean").alias("b"), "item").first()
    assert typed.t == "OBJECT<b: BOOLEAN, f: DECIMAL(2,1), n: BIGINT, o: OBJECT<big: DECIMAL(20,0), l: ARRAY<VARIANT>>, s: STRING, z: VOID>"
    assert typed.b is False
    assert typed["item"].toPython() == {"n": 1, "f": decimal.Decimal("1.5"), "b": True, "z": None, "s": "1",
                                        "o": {"l": [1, "x", False], "big": decimal.Decimal(12345678901234567890)}}


def test_log_charset_is_chosen_by_file(spark, tmp_path):
    folder = tmp_path / "logs" / "proj+x" / "spid é"
    folder.mkdir(parents=True)
    stats = "{\n 'item_scraped_count': 4,\n 'log_count/ERROR': 2,\n}\n"
    files = {"utf": ("ça va\n" + stats).encode(), "latin": ("ça va\n" + stats).encode("latin-1"), "odd": b"\xff\x00\x81\n" + stats.encode(),
             "late": stats.encode() + b"x" * 3000 + "\nça".encode("latin-1"), "empty": b""}
    for name, data in files.items():
        (folder / f"{name}.log").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        for small in (S.SMALL_FILE, 0):
            logs = S.read_job_logs(spark, str(tmp_path), small_file=small)
            rows = logs.collect()
            assert {(r.job_id, r.charset) for r in rows} == {("utf", "UTF-8"), ("latin", "ISO-8859-1"), ("odd", None), ("late", "ISO-8859-1")}
            assert {(r.project, r.spider) for r in rows} == {("proj+x", "spid é")}
            text = {j: [r.line for r in sorted(rows, key=lambda r: r.line_no) if r.job_id == j] for j in files}
            assert text["utf"] == text["latin"] == ("ça va\n" + stats).splitlines()
            assert text["odd"] == [None] and text["late"][-1] == "ça"
            facts = {r.job_id: (r.items_count, r.errors, r.warnings) for r in L.log_facts(logs).collect()}
            assert facts == {"utf": (4, 2, None), "latin": (4, 2, None), "odd": (None, None, None), "late": (4, 2, None)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_only_checkable_charsets(spark):
    with pytest.raises(ValueError, match="UTF-16"):
        L.decode_logs(spark.createDataFrame([(b"x",)], "content binary"), charsets=["UTF-16"])


def test_purge_split_is_a_partition(spark):
    h = DriverTables(spark, "/root/testdata/sf0.001").history
    a = T.history_to_purge(h, keep=2, scan=5).select("id")
    b = T.history_after_purge(h, keep=2, scan=5).select("id")
    assert a.count() + b.count() == h.count()
    assert a.intersect(b).count() == 0


def test_liveness_stream_equals_batch_sessions(spark):
    sf = "/root/testdata/sf0.001"
    stream = run_append(liveness.node_liveness_stream(DriverTables(spark, sf, streaming=True).beats, "6 hours",
                                                      "1 hour"), "t-x1")
    beats = DriverTables(spark, sf).beats
    wm = beats.agg(F.max("ts")).first()[0]
    from pyspark.sql.window import Window
    w = Window.partitionBy("node_id").orderBy("ts")
    gap = 6 * 3600
    s = (beats.withColumn("_new", F.coalesce(F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")) >= gap,
                                             F.lit(True)).cast("int"))
         .withColumn("_sid", F.sum("_new").over(w))
         .groupBy("node_id", "_sid").agg(F.min("ts").alias("online_from"),
                                        F.timestamp_add("HOUR", F.lit(6), F.max("ts")).alias("offline_at"),
                                        F.count(F.lit(1)).alias("beats")).drop("_sid"))
    import datetime as dt
    s = s.where(F.col("offline_at") <= F.lit(wm - dt.timedelta(hours=1)))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, s.select(*stream.columns).collect()))


def test_node_state_events_agree_with_sessions(spark):
    """X2's transitions: an 'online' at every session start, an 'offline' at
    the end of every session the watermark has passed (and nowhere else)."""
    import datetime as dt
    from pyspark.sql.window import Window
    sf = "/root/testdata/sf0.001"
    ev = run_append(liveness.node_state_stream(DriverTables(spark, sf, streaming=True).beats, 6 * 3600, "1 hour"),
                    "t-x2").collect()
    beats = DriverTables(spark, sf).beats
    w = Window.partitionBy("node_id").orderBy("ts")
    s = (beats.withColumn("_new", F.coalesce(F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")) >= 6 * 3600,
                                             F.lit(True)).cast("int"))
         .withColumn("_sid", F.sum("_new").over(w))
         .groupBy("node_id", "_sid").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect())
    wm = beats.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    trunc = lambda t: t.replace(microsecond=t.microsecond // 1000 * 1000)  # noqa: E731  (timers are ms)
    online = {(r.node_id, r.at) for r in ev if r.event == "online"}
    offline = {(r.node_id, r.at) for r in ev if r.event == "offline"}
    assert online == {(r.node_id, trunc(r.a)) for r in s if trunc(r.a) < trunc(wm)}
    ends = {(r.node_id, trunc(r.b) + dt.timedelta(hours=6)) for r in s}
    assert offline <= ends
    assert {e for e in ends if e[1] < wm - dt.timedelta(seconds=1)} <= offline


def test_small_files_go_into_packs(spark, tmp_path):
    """Packed and plain files give the same lines; only files too long for a pack are files of their own."""
    jobs = spark.range(200).select(F.lit("p").alias("project"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("spider"),
                                   F.concat(F.lit("j"), F.col("id").cast("string")).alias("job_id"), F.explode(F.sequence(F.lit(1), F.col("id") % 3 + 1)).alias("k"), "id")
    items = jobs.withColumn("raw", F.when(F.col("id") == 7, F.concat(F.lit('{"a": "'), F.repeat(F.lit("x"), S.PACKED_FILE // 3), F.lit('"}')))
                            .when(F.col("id") == 9, F.lit("bad")).otherwise(F.format_string('{"k": %d}', "k"))).drop("id")
    plain, packed = str(tmp_path / "a"), str(tmp_path / "b")
    written = [sorted(tuple(r) for r in S.write_job_files(items, root, "raw", "items", order_col="k", packed=root == packed).collect()) for root in (plain, packed)]
    assert written[0] == written[1] and len(written[0]) == 200
    assert [f.name for f in (tmp_path / "b").rglob("*.jl")] == []  # two lines of job 7 just fit
    assert items_of(spark, plain) == items_of(spark, packed, fmt="packed") and len(items_of(spark, plain)) == 399
    long = str(tmp_path / "c")
    longer = items.withColumn("raw", F.when(F.col("job_id") == "j8", F.repeat(F.lit("y"), S.PACKED_FILE)).otherwise(F.col("raw")))
    S.write_job_files(longer, long, "raw", "items", order_col="k", packed=True)
    assert [f.name for f in (tmp_path / "c").rglob("*.jl")] == ["j8.jl"]
    assert len(items_of(spark, long, fmt="packed")) == 399
    logs = spark.createDataFrame([("p", "s", f"j{k}", ("é\n" * k).encode("latin-1" if k % 2 else "utf-8")) for k in range(1, 9)], "project string, spider string, job_id string, content binary")
    for root in (plain, packed):
        S.write_job_files(logs, root, "content", "logs", packed=root == packed)
    got = [sorted(tuple(r) for r in S.read_job_logs(spark, root, packed=root == packed).collect()) for root in (plain, packed)]
    assert got[0] == got[1] and len(got[0]) == 36 and {r[5] for r in got[0]} == {"UTF-8", "ISO-8859-1"}
    assert not list((tmp_path / "b").rglob("*.log"))


def test_packages_go_into_packs(spark, tmp_path):
    rows = [(f"p{k}", "1_0", None if k % 5 == 0 else "1.0", k % 7 == 0) for k in range(40)] + [("p3", "1_0", "1.0", False)]
    packages = spark.createDataFrame(rows, "project string, version string, says string, damaged boolean")
    got = []
    for packed in (False, True):
        root = str(tmp_path / str(packed))
        sums = sorted(tuple(r) for r in S.write_packages(packages, root, packed).collect())
        read = S.read_packages(spark, root, packed=packed).select("project", "version", "layout", "length", "checksum", "info_version")
        got.append((sums, sorted(map(str, read.collect()))))
    assert got[0] == got[1] and len(got[0][0]) == 41 and len(got[0][1]) == 40
    assert not list((tmp_path / "True").rglob("*.egg"))
