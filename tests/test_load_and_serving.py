"""Idempotent loading, reconciliation, and versioned publication."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from calorant.plans.load import LoadConflict, load, publish_coverage, reconciliation
from calorant.plans.serving import Snapshots, retention_plan

ROWS = "pipeline_identity_sha256 string, pipeline_payload_sha256 string, v int"


def test_loading_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "facts")
    one = spark.createDataFrame([("a", "p", 1), ("b", "q", 2)], ROWS)
    assert load(one, path) == {"inserted": 2, "reused": 0}
    assert load(one, path) == {"inserted": 0, "reused": 2}
    assert load(spark.createDataFrame([("b", "q", 2), ("c", "r", 3), ("c", "r", 3)], ROWS), path) == {"inserted": 1, "reused": 1}
    with pytest.raises(LoadConflict):
        load(spark.createDataFrame([("a", "other", 1), ("d", "s", 4)], ROWS), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_counts_are_reconciled(spark):
    rows = spark.createDataFrame([("accepted",), ("accepted",), ("quarantined",), ("replay",)], "outcome string")
    assert tuple(reconciliation(rows).first()) == (4, 2, 1, 1, True)
    assert not reconciliation(rows.union(spark.createDataFrame([("lost",)], "outcome string"))).first().reconciled


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path), ["k"], "d")
    assert s.read() is None
    df = lambda rows: spark.createDataFrame(rows, "k int, d string, v string")
    s.publish("v1", df([(1, "2026-01-01", "a"), (2, "2026-01-01", "b"), (3, "2026-01-02", "c")]), "2026-01-01 00:00:00")
    following = df([(1, "2026-01-01", "a"), (2, "2026-01-01", "x"), (4, "2026-01-03", "d")])
    assert s.publish("v2", following, "2026-01-02 00:00:00")["counts"] == {"unchanged": 1, "update": 1, "insert": 1, "delete": 1}
    assert s.publish("v3", following, "2026-01-03 00:00:00") == {"reused": True, "version_id": "v2"}
    assert sorted(map(tuple, s.read().collect())) == sorted(map(tuple, following.collect()))
    assert s.read("v1").count() == 3 and s.read("v9") is None
    assert s.manifest().count() == 2


def test_two_versions_at_least_are_kept(spark):
    versions = spark.createDataFrame([(k,) for k in range(5)], "version_id int").withColumn("published_at", F.make_date(F.lit(2026), F.lit(1), F.col("version_id") + 1))
    assert {r.version_id: r.action for r in retention_plan(versions, keep=1, protected=[0]).collect()} == {4: "keep", 3: "keep", 2: "delete", 1: "delete", 0: "protected"}


def test_coverage_is_published_once(spark, tmp_path):
    path = str(tmp_path / "coverage")
    run = lambda rows, at: spark.createDataFrame([("r1", rows, None, at)], "run_id string, row_count int, note string, published_at_utc string")
    assert publish_coverage(run(5, "t1"), path, "run_id") == {"inserted": 1, "reused": 0}
    assert publish_coverage(run(5, "t2"), path, "run_id") == {"inserted": 0, "reused": 1}
    with pytest.raises(LoadConflict):
        publish_coverage(run(6, "t3"), path, "run_id")
    assert spark.read.parquet(path).count() == 1


def test_cleanup_plans_first_and_takes_markers_back_before_rows(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path), ["k"], "d")
    df = lambda n: spark.createDataFrame([(k, "2026-01-01", str(n)) for k in range(n)], "k int, d string, v string")
    assert s.readiness() == {"ready": False, "reason": "no_ready_version"}
    for n in range(1, 5):
        s.publish(f"v{n}", df(n), f"2026-01-0{n} 00:00:00")
    df(1).write.parquet(f"{tmp_path}/versions/broken")
    assert s.readiness()["ready"] and s.readiness()["actual_rows"] == 4
    want = {"kept": ["v4", "v3"], "retired": ["v2", "v1"], "invisible": ["broken"]}
    assert s.cleanup() == want | {"disposition": "planned"} and s.read("v1").count() == 1
    for wrong in ({"apply": True}, {"keep": 1}, {"protected": ("v1",)}):
        with pytest.raises(ValueError):
            s.cleanup(**wrong)
    assert s.cleanup(apply=True, locked=True, protected=("v4",)) == want | {"disposition": "removed"}
    assert s.read("v1") is None and s.read().count() == 4 and set(s._folders()) == {"v3", "v4"}
    assert s.cleanup(apply=True, locked=True)["disposition"] == "nothing_to_remove"
    with pytest.raises(ValueError):
        s.publish("v4", df(2), "2026-01-09 00:00:00")
    assert s.read().count() == 4
    df(3).write.mode("overwrite").parquet(f"{tmp_path}/versions/v4")
    assert s.readiness()["reason"] == "row_count_mismatch"
