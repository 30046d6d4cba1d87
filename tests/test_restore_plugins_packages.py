"""Restore in order, plugin table functions, package files."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from crawlgrid.operators import plugins as P
from crawlgrid.operators import sinks as W
from crawlgrid.sources import catalog as C
from crawlgrid.sources import files as S


def test_parents_come_first():
    order = C.parents_first(C.SCHEMAS)
    assert sorted(order) == sorted(C.SCHEMAS)
    for table, refers in C.FOREIGN_KEYS.items():
        for column, parent in refers.items():
            assert column in [f.name for f in C.SCHEMAS[table].fields] and order.index(parent) < order.index(table)


def tables(spark, **rows):
    return {name: spark.createDataFrame([tuple(r.get(f.name) for f in C.SCHEMAS[name].fields) for r in got], C.SCHEMAS[name]) for name, got in rows.items()}


def test_restore_reports_orphans(spark, tmp_path):
    current = tables(spark, user=[{"id": 1}], projects=[{"id": 1, "name": "old", "owner_id": 1}], spiders=[{"id": 10, "project_id": 1, "name": "kept"}], triggers=[])
    snapshot = tables(spark,  # children first: the order is found, not given
                      triggers=[{"id": 100, "spider_id": 10}, {"id": 101, "spider_id": 12}, {"id": 102, "spider_id": 13}, {"id": 103, "spider_id": None}],
                      spiders=[{"id": 11, "project_id": 1}, {"id": 12, "project_id": 9}],
                      projects=[{"id": 1, "name": "new", "owner_id": 1}, {"id": 2, "name": "x", "owner_id": 7}, {"id": 3, "name": "y"}])
    restored, report = W.restore_catalog(current, snapshot, str(tmp_path))
    got = sorted(tuple(r) for r in report.collect())
    assert got == [("projects", "2", "owner_id", "7"), ("spiders", "12", "project_id", "9"), ("triggers", "101", "spider_id", "12"), ("triggers", "102", "spider_id", "13")]
    assert sorted((r.id, r.name) for r in restored["projects"].collect()) == [(1, "new"), (3, "y")]
    assert sorted(r.id for r in restored["spiders"].collect()) == [10, 11]
    assert sorted(r.id for r in C.read_catalog(spark, str(tmp_path), ["triggers"])["triggers"].collect()) == [100, 103]
    again, report = W.restore_catalog(restored, snapshot, str(tmp_path / "again"))
    assert report.count() == 4 and again["triggers"].count() == 2



def test_restore_broadcasts_few_keys_only(spark, tmp_path):
    """The files of many ids are small, but not what a driver would hold of them."""
    n = W.FEW_KEYS + 20_000 if hasattr(W, "FEW_KEYS") else 120_000
    schema = {t: C.SCHEMAS[t].fieldNames() for t in ("spiders", "triggers", "job_history")}

    def rows(table, key, **columns):
        return spark.range(n).select(*(columns.get(c, key if c == "id" else F.lit(None)).cast(C.SCHEMAS[table][c].dataType).alias(c) for c in schema[table]))

    k = F.col("id")
    snapshot = {"spiders": rows("spiders", k), "triggers": rows("triggers", k, spider_id=k + 7), "job_history": rows("job_history", k, spider_id=F.when(k % 2 == 0, k - 3))}
    current = {"spiders": rows("spiders", k + n - 5), "triggers": rows("triggers", k * 3), "job_history": rows("job_history", k)}
    kept = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        restored, report = W.restore_catalog(current, snapshot, str(tmp_path))
        counts = {t: restored[t].count() for t in snapshot}
        assert sorted(tuple(r) for r in report.select("table", "key", "value").collect()) == sorted([("job_history", "0", "-3"), ("job_history", "2", "-1")])
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", kept)
    # spiders n-5 to 2n-6 were there before, so all that triggers name are found
    assert counts == {"spiders": 2 * n - 5, "triggers": n + sum(1 for x in range(n) if x * 3 >= n), "job_history": n}


def plugin():
    def split_variants(parameters):  # local, so that it travels to the workers by value
        if parameters.get("ENABLED") != "True":
            return []
        return [("set_dict", "ITEM_PIPELINES", "split.Pipeline", parameters.get("ORDER", "500"), "int"), ("set_var", "SPLIT", None, "a", "string"),
                ("set_var", "SPLIT", None, "b", "string"), ("unknown", "x", None, "1", "int")]

    return split_variants


def test_plugin_table_function_equals_the_operations(spark, monkeypatch):
    monkeypatch.setattr(P, "_PLUGINS", {})
    split_variants = plugin()
    enabled = spark.createDataFrame([(1, 1, "split-variants", {"ENABLED": "True", "ORDER": "7"}), (1, 0, "other", {"V": "z"}), (2, 0, "split-variants", {}),
                                     (3, 0, "split-variants", None), (4, 0, "not registered", {"V": "1"}), (5, 2, "other", {"V": "late"}), (5, 1, "split-variants", {"ENABLED": "True"})],
                                    "spider_id long, pos int, plugin string, parameters map<string,string>")
    with pytest.raises(ValueError):
        P.plugin_operations(enabled)
    P.register_plugin(spark, "split-variants", split_variants)
    P.register_plugin(spark, "other", lambda p: [("set_var", "SPLIT", None, p["V"], "string")])
    got = sorted(tuple(r) for r in P.apply_setting_ops(P.plugin_operations(enabled), {}).select("spider_id", "kind", "name", "key", "value").collect())
    ops = [(1, 0, "set_var", "SPLIT", None, "z", "string"), (5, 2000, "set_var", "SPLIT", None, "late", "string")]
    for spider, pos, parameters in ((1, 1000, {"ENABLED": "True", "ORDER": "7"}), (5, 1000, {"ENABLED": "True"})):
        ops += [(spider, pos + k, *o) for k, o in enumerate(split_variants(parameters))]
    rows = spark.createDataFrame(ops, "spider_id long, pos long, op string, name string, key string, value string, value_type string")
    assert got == sorted(tuple(r) for r in P.apply_setting_ops(rows, {}).select("spider_id", "kind", "name", "key", "value").collect())
    assert (5, "var", "SPLIT", None, '"late"') in got and (1, "var", "SPLIT", None, '"b"') in got


def egg(version=None, member=S.PKG_INFO):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("spiders/a.py", "x = 1\n" * 500)
        archive.writestr(member, "Metadata-Version: 1.1\n" + (f"Version: {version}\n" if version else ""))
    return out.getvalue()


def test_packages_are_read_from_their_files(spark, tmp_path):
    files = {"eggs/proj/1_0.egg": egg("1.0"), "eggs/proj/1_10.egg": egg("1.10"), "eggs/proj/1_9.egg": egg(), "projects/7/eggs/2.egg": egg("2", "other/PKG-INFO"),
             "projects/7/eggs/3.egg": egg("3")[:200], "projects/7/eggs/4.egg": b"no archive"}
    for path, data in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    got = {(r.project, r.version): (r.layout, r.length, r.checksum, r.info_version) for r in S.read_packages(spark, str(tmp_path)).collect()}
    says = {"1_0": "1.0", "1_10": "1.10"}
    want = {}
    for path, data in files.items():
        project, version = path.split("/")[1], path.split("/")[-1][:-4]
        want[project, version] = ("v1" if path.startswith("eggs") else "v2", len(data), hashlib.sha1(data).hexdigest(), says.get(version))
    assert got == want
    listed = S.package_versions(S.job_file_index(S.read_packages(spark, str(tmp_path)).select("path")))
    assert [(r.version, r.is_latest) for r in listed.where(F.col("project") == "proj").collect()] == [("1_0", False), ("1_9", False), ("1_10", True)]
