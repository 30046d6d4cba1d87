"""Adapter views: the crawl-operations tables derived from the driver tables.

Each view is a deterministic projection of one (rarely two) driver tables, so
its size grows with the data. The DuckDB twin of every view lives in
``crawlgrid.plans.oracle_views``; the two must stay expression-for-expression
equivalent. Modulus rules spread attributes (status, tags, flags) over rows;
they never drop rows to make a check cheaper.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlgrid.session import prepare_session

ANCHOR = "2024-01-01 00:00:00"      # the as_of used by the registered queries
SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]


def anchor() -> Column:
    return F.lit(ANCHOR).cast("timestamp_ntz")


def before_anchor(secs: Column) -> Column:
    return F.timestamp_add("SECOND", -secs, anchor())


def job_id(key: Column) -> Column:
    """No fixed width: keys of any length give distinct ids."""
    return F.concat(F.lit("j"), key.cast("string"))


def seg(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (idx + 1).cast("int"))


def _s(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


class DriverTables:
    """Lazy access to the driver's parquet tables and the adapter views."""

    def __init__(self, spark: SparkSession, sf_dir: str, streaming: bool = False,
                 max_files_per_trigger: int = 1):
        self.spark = prepare_session(spark)
        self.dir = sf_dir.rstrip("/")
        self.streaming = streaming
        self.max_files = max_files_per_trigger

    def raw(self, name: str) -> DataFrame:
        """A driver table; with ``streaming=True`` a file-source stream of it
        (row-wise views built on it are then streams too)."""
        path = f"{self.dir}/{name}.parquet"
        if not self.streaming:
            return self.spark.read.parquet(path)
        schema = self.spark.read.parquet(path).schema
        return (self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
                .option("maxFilesPerTrigger", self.max_files).parquet(self.dir))

    # ---- dimension-like views -------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        r = self.raw("region")
        return r.select(
            (F.col("r_regionkey") + 1).alias("id"),
            F.col("r_name").alias("username"),
            (F.col("r_regionkey") == 0).alias("is_admin"),
            F.lit(1).alias("is_active"),
        )

    @cached_property
    def user_keys(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select(
            k.alias("id"),
            (k % 160).alias("user_id"),
            F.concat(F.lit("ak"), _s(k)).alias("app_key"),
            F.concat(F.lit("as"), _s(k)).alias("app_secret"),
            (k % 9 != 0).alias("enabled"),
        )

    @cached_property
    def projects(self) -> DataFrame:
        n = self.raw("nation")
        k = F.col("n_nationkey")
        return n.select(
            k.alias("id"),
            F.col("n_name").alias("name"),
            _s("n_regionkey").alias("version"),
            (1 + k % 2).alias("storage_version"),
            F.when(k % 4 == 3, F.lit(None)).otherwise(F.col("n_regionkey") + 1).alias("owner_id"),
        )

    @cached_property
    def spiders(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select(
            k.alias("id"),
            F.when(k % 37 == 36, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("project_id"),
            F.col("c_name").alias("name"),
        )

    @cached_property
    def settings(self) -> DataFrame:
        """spider_settings EAV rows (id, spider_id, setting_key, value)."""
        c = self.raw("customer")
        k = F.col("c_custkey")
        seg_lower = F.lower("c_mktsegment")

        def row(n, key, value, keep):
            return F.struct(F.lit(n).alias("n"), F.lit(key).alias("setting_key"),
                            value.cast("string").alias("value"), keep.alias("keep"))

        tag = (F.when(k % 4 == 1, F.lit(None))
               .when(k % 4 == 2, seg_lower)
               .otherwise(F.concat(seg_lower, F.lit(","), seg(F.col("c_nationkey") % 5))))
        timeout = F.when(k % 29 == 0, F.lit("abc")).otherwise(_s(30 + 900 * (k % 5)))
        batch = F.when(k % 11 == 0, F.lit("x")).otherwise(_s(k % 6))
        rows = F.array(
            row(0, "tag", tag, k % 4 != 0),
            row(1, "timeout", timeout, k % 3 != 0),
            row(2, "webhook_payload", F.concat(F.lit("http://hook.example/"), _s(k)), k % 2 == 0),
            row(3, "webhook_batch_size", batch, F.lit(True)),
            row(4, "concurrency", F.when(k % 5 == 0, F.lit("2")).otherwise(F.lit("1")), k % 5 <= 1),
            row(5, "extra_requirements", F.lit("requests;lxml"), k % 7 == 0),
            row(6, "timeout", F.lit("600"), k % 13 == 0),
            row(7, "color", F.lit("blue"), k % 17 == 0))
        # one scan of customer: every spider's rows as an exploded array
        return (c.select(k.alias("spider_id"), F.explode(rows).alias("r")).where("r.keep")
                .select((F.col("spider_id") * 8 + F.col("r.n")).alias("id"), "spider_id",
                        "r.setting_key", "r.value"))

    @cached_property
    def parameters(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        rows = F.array(F.struct(F.lit(0).alias("n"), F.lit("nation").alias("parameter_key"),
                                _s("c_nationkey").alias("value")),
                       F.struct(F.lit(1).alias("n"), F.lit("segment").alias("parameter_key"),
                                F.col("c_mktsegment").alias("value")))
        return (c.select(k.alias("spider_id"), F.explode(rows).alias("r"))
                .select((F.col("spider_id") * 2 + F.col("r.n")).alias("id"), "spider_id",
                        "r.parameter_key", "r.value"))

    @cached_property
    def triggers(self) -> DataFrame:
        p = self.raw("part")
        k, sz = F.col("p_partkey"), F.col("p_size")
        cat = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
        bad = (F.when((k / 13).cast("long") % 3 == 0, cat(_s(sz), " * * *"))
               .when((k / 13).cast("long") % 3 == 1, F.lit("61 * * * *"))
               .otherwise(F.lit("* * * * * *")))
        m = k % 8
        good = (F.when(m == 0, cat(_s(sz % 60), " * * * *"))
                .when(m == 1, cat("*/", _s(sz % 30 + 1), " ", _s(sz % 24), " * * *"))
                .when(m == 2, cat("0 ", _s(sz % 24), "-23 * * mon-fri"))
                .when(m == 3, cat(_s(sz % 60), " ", _s(sz % 24), " * * ", _s(k % 7)))
                .when(m == 4, cat("0 0 ", _s(sz % 28 + 1), " jan-jun,oct *"))
                .when(m == 5, cat("15,45 */", _s(sz % 12 + 1), " * * *"))
                .when(m == 6, cat("0 12 * ", _s(sz % 12 + 1), " *"))
                .otherwise(cat("5/", _s(sz % 20 + 5), " 8-18/2 last * *")))
        return p.select(
            k.alias("id"),
            F.floor(k * 3 / 4).cast("long").alias("spider_id"),
            F.when(k % 13 == 0, bad).otherwise(good).alias("cron_pattern"),
        )

    # ---- queue, history -------------------------------------------------
    def _job_common(self, o: DataFrame) -> list[Column]:
        k = F.col("o_orderkey")
        return [
            job_id(k).alias("id"),
            F.concat(F.lit("project_"), _s(F.col("o_custkey") % 25)).alias("project_name"),
            F.concat(F.lit("spider_"), _s("o_custkey")).alias("spider_name"),
            F.timestamp_add("HOUR", k % 7, F.col("o_orderdate")).alias("fire_time"),
        ]

    @cached_property
    def queue(self) -> DataFrame:
        o = self.raw("orders").where(F.col("o_orderstatus").isin("O", "P"))
        k = F.col("o_orderkey")
        status = (F.when(F.col("o_orderstatus") == "O", 0)
                  .when(k % 23 == 0, 2).when(k % 29 == 0, 3)
                  .when(k % 5 == 0, 5).otherwise(1))
        pend = F.col("o_orderstatus") == "O"
        fire = F.timestamp_add("HOUR", k % 7, F.col("o_orderdate"))
        return o.select(
            *self._job_common(o),
            F.when(k % 41 == 0, F.col("o_custkey") + 1000000000).otherwise(F.col("o_custkey")).alias("spider_id"),
            F.lit(1).alias("slot"),
            F.when(pend, F.lit(None)).otherwise(before_anchor(k % 7200)).alias("start_time"),
            F.when(pend, F.lit(None)).otherwise((k / 150).cast("long")).alias("node_id"),
            status.alias("status"),
            F.when(pend, fire).otherwise(before_anchor((k % 13) * 10)).alias("update_time"),
            F.when(pend, F.lit(None)).otherwise((k % 30000).cast("int")).alias("pid"),
            F.when(k % 3 == 0, F.lit("machinery")).alias("tag"),
            F.when(k % 4 == 0, F.concat(F.lit('{"spider_parameters": {"prio": "'),
                                        F.col("o_orderpriority"), F.lit('"}}'))).alias("settings"),
        )

    @cached_property
    def history(self) -> DataFrame:
        o = self.raw("orders").where(F.col("o_orderstatus") == "F")
        k = F.col("o_orderkey")
        fire = F.timestamp_add("HOUR", k % 7, F.col("o_orderdate"))
        start = F.timestamp_add("MINUTE", k % 11, fire)
        m9 = k % 9
        return o.select(
            *self._job_common(o),
            F.when(k % 53 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("spider_id"),
            start.alias("start_time"),
            F.when(k % 61 == 0, F.lit(None)).otherwise(F.timestamp_add("SECOND", k % 5000, start)).alias("complete_time"),
            F.when(m9.isin(5, 6), 3).when(m9 == 7, 4).when(m9 == 8, 6).otherwise(2).alias("status"),
            F.when(k % 10 == 0, F.lit(None)).otherwise((k % 8).cast("int")).alias("items_count"),
        )

    # ---- items and logs ---------------------------------------------------
    @cached_property
    def items(self) -> DataFrame:
        """job_items: (job_id, line_no, raw) plus the job's project/spider."""
        li = self.raw("lineitem")
        k = F.col("l_orderkey")
        w = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        ln = F.col("line_no")
        odd = F.concat(F.lit('{"partkey": '), _s("l_partkey"),
                       F.lit(', "quantity": '), _s(F.round("l_quantity").cast("long")),
                       F.lit(', "price": '), _s(F.round(F.col("l_extendedprice") * 100).cast("long")),
                       F.lit("}"))
        even = F.concat(F.lit('{"partkey": '), _s("l_partkey"),
                        F.lit(', "suppkey": '), _s("l_suppkey"),
                        F.lit(', "ship": {"flag": "'), F.col("l_returnflag"), F.lit('"}}'))
        whole = F.concat(F.lit('{"partkey": '), _s("l_partkey"), F.lit("}"))
        bad = (F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(F.lit('{"partkey": '), _s("l_partkey")))
               .when(k % 5 == 2, F.replace(whole, F.lit('"'), F.lit("'"))).when(k % 5 == 3, F.concat(whole, F.lit(" x")))
               .otherwise(F.concat(whole, whole)))
        return (li.withColumn("line_no", F.row_number().over(w))
                .select(
                    F.concat(F.lit("project_"), _s(k % 7)).alias("project"),
                    F.concat(F.lit("spider_"), _s(k % 97)).alias("spider"),
                    job_id(k).alias("job_id"),
                    ln.alias("line_no"),
                    F.when((k % 17 == 0) & (ln == 3), bad)
                     .when(ln % 2 == 1, odd).otherwise(even).alias("raw")))

    @cached_property
    def log_text(self) -> DataFrame:
        """One log text per job: the document text plus a crawl stats block."""
        d = self.raw("documents")
        n = F.col("n_chars")
        nl = F.lit("\n")
        stats = F.concat(
            nl, F.lit("{'downloader/request_count': "), _s(n % 9), F.lit(","),
            nl, F.lit(" 'item_scraped_count': "), _s(n % 50),
            F.when(n % 7 == 0, F.lit("")).otherwise(F.lit(",")),
            F.when(n % 5 == 0, F.concat(nl, F.lit(" 'log_count/ERROR': "), _s(n % 3), F.lit(","))).otherwise(F.lit("")),
            F.when(n % 3 == 0, F.concat(nl, F.lit(" 'log_count/WARNING': "), _s(n % 4), F.lit(","))).otherwise(F.lit("")),
            nl, F.lit(" 'log_count/INFO': 7}"),
        )
        return d.select(
            F.concat(F.lit("project_"), _s(F.col("doc_id") % 7)).alias("project"),
            F.concat(F.lit("spider_"), _s(F.col("doc_id") % 97)).alias("spider"),
            job_id(F.col("doc_id") * 15).alias("job_id"),
            F.concat(F.col("text"), stats).alias("text"), "doc_id", "lang")

    @cached_property
    def logs(self) -> DataFrame:
        """job_logs: (project, spider, job_id, line_no, line)."""
        return (self.log_text
                .select("project", "spider", "job_id",
                        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
                .select("project", "spider", "job_id",
                        (F.col("pos") + 1).alias("line_no"), "line"))

    # ---- nodes, keys, sessions, events --------------------------------------
    @cached_property
    def nodes(self) -> DataFrame:
        s = self.raw("supplier")
        k, nk = F.col("s_suppkey"), F.col("s_nationkey")
        tags = (F.when(nk % 7 == 0, F.lit(None).cast("array<string>"))
                .when(nk % 7 == 1, F.array().cast("array<string>"))
                .otherwise(F.array(seg(nk % 5), seg(F.floor(nk / 5) % 5))))
        return s.select(
            k.alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("10.0."), _s(F.floor(k / 256)), F.lit("."), _s(k % 256)).alias("client_ip"),
            F.lit("2023-12-01 00:00:00").cast("timestamp_ntz").alias("create_time"),
            before_anchor((k * 7) % 180).alias("last_heartbeat"),
            F.when(k % 6 == 0, 0).otherwise(1).alias("isalive"),
            tags.alias("tags"),
            F.when(k % 9 == 0, F.lit(True)).when(k % 9 == 1, F.lit(None)).otherwise(F.lit(False)).alias("is_deleted"),
            F.when(k % 2 == 0, k).alias("node_key_id"),
        )

    @cached_property
    def node_keys(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        return o.select(
            k.alias("id"),
            F.concat(F.lit("nk"), _s(k)).alias("key"),
            F.concat(F.lit("sk"), _s(k)).alias("secret_key"),
            (k % 11 == 0).alias("is_deleted"),
            F.when(k % 3 == 0, (k / 150).cast("long")).alias("used_node_id"),
            before_anchor(7200 - k % 7200).alias("create_at"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("node_id"),
            F.col("ts").alias("create_at"),
            F.timestamp_add("SECOND", F.col("event_id") % 120, F.col("ts")).alias("last_heartbeat"),
        )

    @cached_property
    def beats(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type").isin("view", "click"))
        return e.select("event_id", F.col("user_id").alias("node_id"),
                        (F.col("user_id") * 10 + F.col("event_id") % 3).alias("session_id"), "ts")

    @cached_property
    def logins(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type").isin("signup", "purchase"))
        u = F.col("user_id")
        return e.select(F.col("event_id").alias("attempt_id"),
                        F.when(u % 10 == 0, F.lit(None)).otherwise(u).alias("node_id"), "ts")

    @cached_property
    def reports(self) -> DataFrame:
        """Running-job reports: (node_id, job_id, ts)."""
        e = self.raw("events").where(F.col("event_type") == "error")
        return e.select(F.col("user_id").alias("node_id"),
                        job_id(F.col("event_id") * 3).alias("job_id"), "ts")

    @cached_property
    def completions(self) -> DataFrame:
        e = self.raw("events")
        eid = F.col("event_id")
        word = (F.when(F.col("event_type").isin("purchase", "view"), F.lit("success"))
                .when(F.col("event_type").isin("error", "click"), F.lit("fail"))
                .otherwise(F.lit("bogus")))
        key = (eid - eid % 2) * 3        # two reports for each job
        node = F.when(eid % 4 == 0, F.lit(None)).otherwise(
            (key / 150).cast("long") + F.when(eid % 10 == 1, 1).otherwise(0))
        return e.select(eid.alias("completion_id"), job_id(key).alias("job_id"),
                        node.alias("node_id"), word.alias("status"), "ts")

    @cached_property
    def packages(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        return p.select(
            k.alias("id"),
            (k % 25).cast("int").alias("project_id"),
            k.alias("version"),
            F.regexp_replace("p_name", " ", ",").alias("spider_list"),
            F.concat(_s("p_size"), F.lit("."), _s(k % 10)).alias("egg_version"),
            F.sha1(F.col("p_name").cast("binary")).alias("checksum"),
            F.concat(F.lit("projects/"), _s(k % 25), F.lit("/eggs/"), _s(k), F.lit(".egg")).alias("file_path"),
            F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")).cast("timestamp_ntz").alias("create_date"),
        )

    @cached_property
    def webhook_jobs(self) -> DataFrame:
        o = self.raw("orders").where(F.col("o_orderstatus") == "F")
        k = F.col("o_orderkey")
        return o.select(
            k.alias("id"),
            job_id(k + k % 2).alias("job_id"),
            F.col("o_custkey").alias("spider_id"),
            F.concat(F.lit("http://hook.example/"), _s("o_custkey")).alias("payload_url"),
            (k % 4).cast("int").alias("status"),
            F.when(k % 4 == 3, F.lit("error")).alias("log"),
        )

    @cached_property
    def webhook_events(self) -> DataFrame:
        e = self.raw("events")
        kind = (F.when(F.col("event_type") == "view", "start")
                .when(F.col("event_type").isin("purchase", "signup"), "finish")
                .when(F.col("event_type") == "error", "fail")
                .otherwise("restart"))
        return e.select(F.col("event_id"), (F.col("event_id") * 3).alias("webhook_job_id"),
                        kind.alias("event"), F.concat(F.lit("log "), _s("event_id")).alias("log"), "ts")

    @cached_property
    def requests(self) -> DataFrame:
        """Schedule / trigger requests submitted by users."""
        c = self.raw("customer")
        n = self.raw("nation")
        k = F.col("c_custkey")
        cron = (F.when(k % 4 == 0, F.concat(_s(k % 60), F.lit(" * * * *")))
                .when(k % 4 == 1, F.concat(F.lit("0 "), _s(k % 24), F.lit(" * * *")))
                .when(k % 4 == 2, F.lit("0 0 * * * *"))
                .otherwise(F.concat(F.lit("*/"), _s(k % 70), F.lit(" * * * *"))))
        return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
                .select(
                    k.alias("req_id"),
                    (k % 6).cast("int").alias("owner_id"),
                    F.when(k % 19 == 0, F.lit(99)).otherwise(F.col("c_nationkey")).alias("project_id"),
                    F.when(k % 19 == 0, F.lit("NOSUCH")).otherwise(F.col("n_name")).alias("project_name"),
                    F.when(k % 23 == 0, F.lit("nosuch")).otherwise(F.col("c_name")).alias("spider_name"),
                    cron.alias("cron")))

    @cached_property
    def figures(self) -> DataFrame:
        """spider_figure: stored run figures (JSON text)."""
        c = self.raw("customer")
        k = F.col("c_custkey")
        params = F.when(k % 2 == 0, F.concat(F.lit('"settings": {"x": "'), _s(k), F.lit('"}'))).otherwise(
            F.lit('"spider_parameters": {"y": "1", "nation": "override"}'))
        good = F.concat(F.lit('{"spider_name": "fig_'), _s(k), F.lit('", "project_name": "p'), _s("c_nationkey"),
                        F.lit('", "extra_requirements": '), F.when(k % 5 == 0, F.lit('["a","b;c"]')).otherwise(F.lit('"a;b;;c"')), F.lit(", "), params,
                        F.when(k % 3 == 0, F.lit(', "plugin_settings": {"p":{"x":1}}, "plugins": ["p"], "package": "pk"')).otherwise(F.lit("")),
                        F.when(k % 4 == 0, F.lit(', "output": "s3://o"')).otherwise(F.lit("")), F.lit("}"))
        return c.select(k.alias("id"), k.alias("spider_id"),
                        F.when(k % 27 == 0, F.lit("{bad")).otherwise(good).alias("text"))

    @cached_property
    def forms(self) -> DataFrame:
        """Submitted spider settings forms; some spiders get a second one later."""
        c = self.raw("customer")
        k = F.col("c_custkey")
        nk = _s("c_nationkey")
        first = c.select(
            k.alias("form_id"), k.alias("spider_id"),
            F.when(k % 5 == 0, F.lit(None)).otherwise(_s(k % 3 + 1)).alias("concurrency"),
            F.when(k % 7 == 0, F.lit(None)).otherwise(_s(60 * (k % 10))).alias("timeout"),
            F.when(k % 2 == 0, F.concat(F.lit("http://new.example/"), _s(k))).alias("webhook_payload"),
            F.when(k % 3 == 0, F.lit("5")).alias("webhook_batch_size"),
            F.when(k % 4 == 0, F.lit("  ")).when(k % 4 == 1, F.lit(None))
             .otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))).alias("tag"),
            F.when(k % 6 == 0, F.lit("")).otherwise(F.lit("lxml;requests")).alias("extra_requirements"),
            F.array(F.lit(" nation "), F.lit(""), F.lit("segment"), F.lit("nation")).alias("param_keys"),
            F.array(nk, F.lit("x"), F.col("c_mktsegment"), F.concat(F.lit("N"), nk)).alias("param_values"),
            F.when(k % 5 == 0, F.lit('{"spider": "f"}')).when(k % 5 == 1, F.lit("{bad")).alias("figure_json"))
        none = F.lit(None).cast("string")
        again = c.where((k % 10 == 4) | (k % 10 == 0)).select(
            (k + 1_000_000_000).alias("form_id"), k.alias("spider_id"), F.lit("9").alias("concurrency"), none.alias("timeout"),
            F.when(k % 20 == 4, F.concat(F.lit("http://again.example/"), _s(k))).alias("webhook_payload"), none.alias("webhook_batch_size"),
            F.lit(" again").alias("tag"), F.lit("").alias("extra_requirements"),
            F.array(F.lit("b"), F.lit(" b")).alias("param_keys"), F.array(F.lit("1"), F.lit("2")).alias("param_values"),
            F.when(k % 20 == 4, '[1, {"x": 2}]').otherwise('{"a": 1} x').alias("figure_json"))
        return first.unionByName(again)

    @cached_property
    def plugin_descriptors(self) -> DataFrame:
        """Uploaded plugin descriptors; a brand is a plugin name, so names repeat
        (a re-upload) and the latest plugin_id wins."""
        p = self.raw("part")
        k, sz = F.col("p_partkey"), F.col("p_size")
        name = F.concat(F.lit("plugin"), F.regexp_replace("p_brand", "Brand#", ""))
        enabled_default = F.when(sz % 3 == 0, F.lit("true")).when(sz % 3 == 1, F.lit("false")).otherwise(F.lit("null"))
        size_default = F.when(sz % 4 == 0, F.lit("0")).otherwise(_s(sz))
        kind_default = F.when(k % 5 == 0, F.lit('""')).otherwise(F.concat(F.lit('"'), F.lower("p_type"), F.lit('"')))
        desc = F.concat(
            F.lit('{"name": "'), name, F.lit('", "parameters": {"ENABLED": {"type": "bool", "required": true, '),
            F.lit('"default_value": '), enabled_default, F.lit('}, "SIZE": {"type": "int", "required": '),
            F.when(sz % 2 == 0, F.lit("true")).otherwise(F.lit("false")), F.lit(', "default_value": '), size_default,
            F.lit('}, "KIND": {"type": "string", "default_value": '), kind_default, F.lit("}}}"))
        return p.select(k.alias("plugin_id"), desc.alias("descriptor"))

    @cached_property
    def plugin_values(self) -> DataFrame:
        """Per-spider plugin settings: (spider_id, plugin_name, key, value)."""
        c = self.raw("customer")
        k = F.col("c_custkey")
        name = F.concat(F.lit("plugin"), _s(k % 25 + 1))
        en = (F.when(k % 4 == 0, F.lit("True")).when(k % 4 == 1, F.lit("foo"))
              .when(k % 4 == 2, F.lit(None)).otherwise(F.lit("0")))
        size = F.when(k % 3 == 0, F.lit("x")).otherwise(_s(k % 50))
        a = c.select(k.alias("spider_id"), name.alias("plugin_name"), F.lit("ENABLED").alias("key"), en.alias("value"))
        b = c.select(k.alias("spider_id"), name.alias("plugin_name"), F.lit("SIZE").alias("key"), size.alias("value"))
        return a.unionByName(b).where(F.col("value").isNotNull())

    @cached_property
    def setting_ops(self) -> DataFrame:
        """Setting operations emitted by plugins, in order per spider."""
        p = self.raw("part")
        k, sz = F.col("p_partkey"), F.col("p_size")
        op = F.when(sz % 3 == 0, F.lit("set_var")).when(sz % 3 == 1, F.lit("set_dict")).otherwise(F.lit("set_env"))
        vt = F.when(k % 3 == 0, F.lit("int")).when(k % 3 == 1, F.lit("bool")).otherwise(F.lit("str"))
        val = (F.when(k % 3 == 0, _s(sz)).when(k % 3 == 1, F.when(sz % 2 == 0, F.lit("true")).otherwise(F.lit("false")))
               .otherwise(F.col("p_name")))
        return p.select(F.floor(k / 8).cast("long").alias("spider_id"), (k % 8).cast("int").alias("pos"),
                        op.alias("op"),
                        F.when(sz % 3 == 1, F.concat(F.lit("DICT_"), _s(sz % 2)))
                         .otherwise(F.concat(F.lit("VAR_"), _s(sz % 4))).alias("name"),
                        F.lower("p_type").alias("key"), val.alias("value"), vt.alias("value_type"))
