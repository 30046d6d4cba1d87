"""Writers, snapshot / restore, outgoing feeds, storage migration, backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from crawlgrid.constants import FAIL, FAIL_MAIL_BODY, FAIL_MAIL_SUBJECT
from crawlgrid.functions.text import job_path, package_path
from crawlgrid.operators.aggregates import dedupe_eav
from crawlgrid.sources.catalog import FOREIGN_KEYS, parents_first, primary_key

FEW_KEYS = 100_000  # that a driver and each task hold


def write_job_data(items: DataFrame, root: str, mode: str = "overwrite") -> str:
    """Store item (or log) lines by project and spider, sorted by job and
    line inside each file; one directory per (project, spider), not per job.
    Readers prune partitions on project / spider and skip row groups on job_id.

    Range partitioning on (project, spider, job_id) gives every task one
    contiguous key range, so each task writes into few directories (files ≈
    tasks + directories, not tasks × directories) and a spider holding a
    third of all lines is still split over many tasks by job ranges."""
    (items.repartitionByRange("project", "spider", "job_id")
     .sortWithinPartitions("project", "spider", "job_id", "line_no")
     .write.mode(mode).partitionBy("project", "spider").parquet(root))
    return root


def snapshot_catalog(tables: dict[str, DataFrame], path: str, names: list[str] | None = None) -> DataFrame:
    """Write each table under ``path/<name>`` and report its row count,
    counted while writing (``observe``), not by a second scan."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name in names or list(tables):
        obs = Observation(f"snapshot_{name}")
        tables[name].observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{name}")
        counts.append((name, int(obs.get["rows"])))
    return spark.createDataFrame(counts, "table string, rows long")


def keys_to_join(keys: DataFrame, rows: int) -> DataFrame:
    """Keys to look up in: broadcast if they are few, sorted and merged if not.
    Spark would choose by the size of their files, of which compression leaves
    little: some MB of ids are hundreds of MB in the driver."""
    return F.broadcast(keys) if rows <= FEW_KEYS else keys.hint("merge")


def restore_merge(current: DataFrame, snapshot: DataFrame, pk: list[str], rows: int | None = None) -> DataFrame:
    """Merge a snapshot into a table by primary key: snapshot rows replace
    or add, current rows without a snapshot twin stay. ``rows``: at least as
    many as the snapshot has, if known."""
    keys = snapshot.select(*pk)
    return current.join(keys if rows is None else keys_to_join(keys, rows), pk, "left_anti").unionByName(snapshot)


def restore_catalog(current: dict[str, DataFrame], snapshot: dict[str, DataFrame], root: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """W3 over a whole backup: every table of ``snapshot`` merged into
    ``current`` and written under ``root``, parents before children.

    A snapshot row whose foreign key names no row of the parent as restored
    (or as it is in ``current``, if the parent isn't in the backup) is not
    written but reported, and so are the rows that refer to it; NULL refers to
    nothing. Returns the restored tables and the report (table, key, column,
    value), a row for each missing reference. The parents' keys are unique, so
    each check is an equijoin that keeps the row count; what is joined with is
    counted first."""
    spark = next(iter(snapshot.values())).sparkSession
    restored, report, counts = dict(current), None, {}
    for name in parents_first(snapshot):
        key, rows = primary_key(name), snapshot[name]
        refers = {c: p for c, p in FOREIGN_KEYS.get(name, {}).items() if c in rows.columns and p in restored}
        marked = rows
        for column, parent in refers.items():
            if parent not in counts:
                counts[parent] = restored[parent].count()
            ids = keys_to_join(restored[parent].select(F.col(primary_key(parent)).alias(f"_has_{column}")).distinct(), counts[parent])
            marked = marked.join(ids, marked[column] == ids[f"_has_{column}"], "left")
        missing = [F.when(F.col(c).isNotNull() & F.col(f"_has_{c}").isNull(), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c in refers]
        marked = marked.select(*rows.columns, F.filter(F.array(*missing) if missing else F.array().cast("array<struct<column:string,value:string>>"),
                                                       lambda m: m.isNotNull()).alias("_missing"))
        marked.write.mode("overwrite").parquet(f"{root}/_checked/{name}")
        marked = spark.read.parquet(f"{root}/_checked/{name}")
        good = marked.where(F.size("_missing") == 0).drop("_missing")
        whole = restore_merge(current[name], good, [key], marked.count()) if name in current else good
        whole.write.mode("overwrite").parquet(f"{root}/{name}")
        restored[name] = spark.read.parquet(f"{root}/{name}")
        counts.pop(name, None)
        orphans = marked.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.inline("_missing"))
        report = orphans if report is None else report.unionByName(orphans)
    return restored, report


def completion_feed(finished: DataFrame, spiders: DataFrame, projects: DataFrame,
                    settings: DataFrame) -> DataFrame:
    """One webhook post per finished job whose spider has a non-empty
    ``webhook_payload`` URL: (job_id, url, body JSON)."""
    hook = (dedupe_eav(settings.where(F.col("setting_key") == "webhook_payload"), "spider_id", "setting_key")
            .where(F.col("value").isNotNull() & (F.col("value") != ""))
            .select(F.col("spider_id").alias("_hsid"), F.col("value").alias("url")))
    s = spiders.select(F.col("id").alias("_sid"), F.col("project_id").alias("_spid"), F.col("name").alias("_sname"))
    p = projects.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"))
    # one row per hooked spider first; the jobs are shuffled once
    sp = s.join(hook, F.col("_sid") == hook._hsid).join(p, F.col("_spid") == p._pid)
    j = finished.join(sp, finished.spider_id == sp._sid)
    body = F.to_json(F.struct(F.lit("job").alias("type"), F.lit("complete").alias("event"),
                              F.col("_pname").alias("project_name"), F.col("_sname").alias("spider_name"),
                              F.col("id").alias("job_id")))
    return j.select(F.col("id").alias("job_id"), "url", body.alias("body"))


def failed_job_alerts(finished: DataFrame, spiders: DataFrame, projects: DataFrame,
                      enabled: bool, receiver: str, subject: str = FAIL_MAIL_SUBJECT) -> DataFrame:
    """One mail row per job that finished with status 3, when enabled.
    The body names the job's project through its spider (jobs whose spider
    is gone cannot be addressed and are skipped)."""
    s = spiders.select(F.col("id").alias("_sid"), F.col("project_id").alias("_spid"))
    p = projects.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"))
    sp = s.join(p, F.col("_spid") == p._pid)
    j = finished.where(F.col("status") == FAIL).join(sp, finished.spider_id == sp._sid)
    if not enabled:
        j = j.where(F.lit(False))
    body = F.format_string(FAIL_MAIL_BODY, F.col("_pname"), F.col("spider_name"), F.col("id"))
    return j.select(F.col("id").alias("job_id"), F.lit(subject).alias("subject"), body.alias("body"),
                    F.lit(receiver).alias("receiver"))


def storage_migration_manifest(projects: DataFrame, spiders: DataFrame, history: DataFrame,
                               file_index: DataFrame, latest_packages: DataFrame) -> DataFrame:
    """For projects still on storage layout 1: move every existing log /
    items file of their jobs and their latest package to layout 2.

    ``file_index``: existing paths (``path``); missing job files are skipped.
    ``latest_packages``: (project_id, version) of each project's latest egg;
    a project without one gets a 'no package' row (the reference errors).
    Output: project_id, kind, old_path, new_path, reason.
    """
    p1 = projects.where(F.col("storage_version") == 1).select(
        F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    s = spiders.select(F.col("id").alias("spider_id"), F.col("project_id"), F.col("name").alias("spider_name"))
    jobs = history.select(F.col("id").alias("job_id"), "spider_id").join(s, "spider_id").join(p1, "project_id")
    files = jobs.select("project_id", F.explode(F.array(
        F.struct(F.lit("log").alias("kind"),
                 job_path(F.lit(1), "project_name", "project_id", "spider_name", "job_id", "log").alias("old_path"),
                 job_path(F.lit(2), "project_name", "project_id", "spider_name", "job_id", "log").alias("new_path")),
        F.struct(F.lit("items").alias("kind"),
                 job_path(F.lit(1), "project_name", "project_id", "spider_name", "job_id", "items").alias("old_path"),
                 job_path(F.lit(2), "project_name", "project_id", "spider_name", "job_id", "items").alias("new_path"))
    )).alias("f")).select("project_id", "f.*")
    existing = file_index.select(F.col("path").alias("old_path"))
    files = files.join(existing, "old_path", "left_semi").withColumn("reason", F.lit(None).cast("string"))
    eggs = (p1.join(latest_packages, "project_id", "left")
            .select("project_id", F.lit("package").alias("kind"),
                    package_path(F.lit(1), "project_name", "project_id", "version").alias("old_path"),
                    package_path(F.lit(2), "project_name", "project_id", "version").alias("new_path"),
                    F.when(F.col("version").isNull(), F.lit("no package")).alias("reason")))
    return files.unionByName(eggs)


def upgrade_tables(users: DataFrame, projects: DataFrame, settings: DataFrame,
                   spider_webhook: DataFrame) -> dict[str, DataFrame]:
    """The data backfills of the schema upgrades: legacy webhook URLs
    become ``webhook_payload`` settings; every project's owner becomes the
    first user; every user is active. The first user id is a scalar subquery."""
    first_user = users.select(F.min("id")).scalar()
    next_id = settings.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    # new setting ids above every existing one: max(id) + the legacy row id
    hooks = spider_webhook.select(
        (next_id + F.col("id")).alias("id"), F.col("id").alias("spider_id"),
        F.lit("webhook_payload").alias("setting_key"), F.col("payload_url").alias("value"))
    return {
        "settings": settings.unionByName(hooks.select(*settings.columns)),
        "projects": projects.withColumn("owner_id", first_user),
        "users": users.withColumn("is_active", F.lit(1)),
    }
