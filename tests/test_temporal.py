"""Revision state machines, as-known joins, windows of states, ranges and overlaps."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from calorant.operators import ranges, relations, spine, temporal

LOG = "logical_id string, source_revision long, record_status string, published_at_utc timestamp_ntz, approved_at_utc timestamp_ntz, approval_state string, tie string"


def clock():
    return F.greatest("published_at_utc", "approved_at_utc")


def day(n: int) -> datetime:
    return datetime(2026, 1, n)


def log(spark, rows):
    """Rows of (id, revision, status, day of publication and approval)."""
    return spark.createDataFrame([(i, r, s, day(d), day(d), "approved", f"{r}") for i, r, s, d in rows], LOG)


def windows(df):
    return sorted(((r.source_revision, r.known_from_utc.day, r.known_to_utc and r.known_to_utc.day) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, "active", 1), (3, "active", 2), (2, "active", 3)], [(1, 1, 2), (3, 2, None)]),
        ([(1, "active", 1), (2, "cancelled", 2)], [(1, 1, 2), (2, 2, None)]),
        ([(1, "active", 1), (2, "active", 1)], [(2, 1, None)]),
        ([], []),
    ],
)
def test_record_highs(spark, rows, want):
    df = log(spark, [("a", *r) for r in rows])
    assert windows(temporal.knowledge_history(df, ["logical_id"], "source_revision", clock(), "tie")) == want


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, "final", 1), (2, "provisional", 2)], [(1, 1, None)]),
        ([(1, "final", 1), (2, "withdrawn", 2)], [(1, 1, 2), (2, 2, None)]),
        ([(1, "provisional", 1), (2, "final", 2), (3, "provisional", 3), (4, "final", 4)], [(1, 1, 2), (2, 2, 4), (4, 4, None)]),
        ([(1, "rejected", 1), (2, "provisional", 2)], [(2, 2, None)]),
    ],
)
def test_final_outlasts_provisional(spark, rows, want):
    df = log(spark, [("a", *r) for r in rows])
    assert windows(temporal.capacity_history(df, ["logical_id"], "source_revision", clock(), "tie", "record_status")) == want


def test_current_never_falls_back(spark):
    df = log(spark, [("a", 1, "active", 1), ("a", 2, "withdrawn", 2), ("b", 1, "active", 1)])
    got = {r.logical_id: r.record_status for r in temporal.latest_revision(df, ["logical_id"], [F.desc("source_revision")]).collect()}
    assert got == {"a": "withdrawn", "b": "active"}


def test_knowledge_histories_are_well_formed(spark):
    """Against brute force: at any instant the known revision is the highest published by then."""
    r = random.Random(4)
    rows = [(f"i{r.randrange(6)}", r.randrange(1, 8), "active", r.randrange(1, 28)) for _ in range(80)]
    history = temporal.knowledge_history(log(spark, rows), ["logical_id"], "source_revision", clock(), "tie").collect()
    for i in {x[0] for x in rows}:
        for d in range(1, 30):
            t = day(1) + timedelta(days=d - 1)
            known = [x[1] for x in rows if x[0] == i and day(x[3]) <= t]
            got = [h.source_revision for h in history if h.logical_id == i and h.known_from_utc <= t and (h.known_to_utc is None or t < h.known_to_utc)]
            assert got == ([max(known)] if known else [])


def test_as_known_at_and_bitemporal(spark):
    history = temporal.knowledge_history(log(spark, [("a", 1, "active", 1), ("a", 2, "active", 5)]), ["logical_id"], "source_revision", clock(), "tie").select("logical_id", "source_revision", "known_from_utc", "known_to_utc")
    asked = spark.createDataFrame([("a", day(1)), ("a", day(4)), ("a", day(5)), ("b", day(5)), ("a", datetime(2025, 12, 31))], "logical_id string, t timestamp_ntz")
    got = {(r.logical_id, r.t): r.source_revision for r in temporal.as_known_at(asked, history, ["logical_id"], "t").collect()}
    assert got == {("a", day(1)): 1, ("a", day(4)): 1, ("a", day(5)): 2, ("b", day(5)): None, ("a", datetime(2025, 12, 31)): None}
    valid = history.withColumns({"effective_from_utc": F.lit("2026-02-01").cast("timestamp_ntz"), "effective_to_utc": F.lit("2026-03-01").cast("timestamp_ntz")})
    cell = spark.createDataFrame([("a", datetime(2026, 2, 1), datetime(2026, 3, 1), day(6)), ("a", datetime(2026, 2, 1), datetime(2026, 3, 2), day(6))], "logical_id string, s timestamp_ntz, e timestamp_ntz, t timestamp_ntz")
    assert [r.source_revision for r in temporal.bitemporal_join(cell, valid, ["logical_id"], "s", "e", "t").orderBy("e").collect()] == [2, None]


def test_states_are_coalesced(spark):
    rows = [("a", day(d), s) for d, s in ((1, "x"), (2, "x"), (3, "y"), (4, "x"), (5, "x"))]
    df = spark.createDataFrame(rows, "k string, known_from_utc timestamp_ntz, state string")
    got = [(r.known_from_utc.day, r.state, r.known_to_utc and r.known_to_utc.day) for r in temporal.coalesce_states(df, ["k"], ["known_from_utc"], "state").orderBy("known_from_utc").collect()]
    assert got == [(1, "x", 3), (3, "y", 4), (4, "x", None)]


def test_range_joins_against_brute_force(spark):
    r = random.Random(7)
    base = datetime(2026, 1, 1)
    at = lambda: base + timedelta(minutes=r.randrange(0, 60 * 24 * 9))
    points = [(i, at()) for i in range(60)]
    spans = [(i, s, s + timedelta(hours=r.randrange(1, 70)) if r.random() < 0.8 else None) for i, s in enumerate(at() for _ in range(25))]
    p, v = spark.createDataFrame(points, "p long, t timestamp_ntz"), spark.createDataFrame(spans, "v long, a timestamp_ntz, b timestamp_ntz")
    got = {(x.p, x.v) for x in ranges.containment_join(p, v, "t", "a", "b").collect()}
    assert got == {(i, k) for i, t in points for k, a, b in spans if a <= t and (b is None or t < b)}
    pairs = {(x.left_v, x.right_v) for x in ranges.overlapping_pairs(v.withColumn("g", F.lit(1)), ["g"], "a", "b", "v").collect()}
    far = datetime(9999, 1, 1)
    assert pairs == {(i, k) for i, a, b in spans for k, c, d in spans if i < k and a < (d or far) and c < (b or far)}
    kinds = {x.p: x.coverage for x in ranges.coverage(p.withColumn("g", F.lit(1)), "p", v.withColumn("g", F.lit(1)).drop("v"), ["g"], "a", "b", "t").collect()}
    n = {i: sum(a <= t and (b is None or t < b) for _, a, b in spans) for i, t in points}
    assert kinds == {i: "missing" if k == 0 else "ok" if k == 1 else "ambiguous" for i, k in n.items()}


def test_spine_is_dense_and_unique(spark):
    runs = spark.createDataFrame([("r1", "succeeded", datetime(2026, 3, 30)), ("r2", "succeeded", datetime(2026, 3, 31)), ("r3", "failed", datetime(2026, 4, 1))], "pipeline_run_id string, reconciliation_status string, generated_at_utc timestamp_ntz")
    runs = runs.withColumns({"start_date_local_inclusive": F.to_date(F.lit("2026-03-28")), "end_date_local_inclusive": F.when(F.col("pipeline_run_id") == "r3", F.to_date(F.lit("2026-05-01"))).otherwise(F.to_date(F.lit("2026-03-30")))})
    held = spark.createDataFrame([("s", "P1", datetime(2020, 1, 1), None), ("s", "P2", datetime(2026, 3, 29, 0, 0), datetime(2026, 3, 29, 12, 0))], "source_system_id string, delivery_point_natural_id string, effective_from_utc timestamp_ntz, effective_to_utc timestamp_ntz")
    got = spine.delivery_spine(runs, held).collect()
    assert len(got) == len({r.delivery_interval_key for r in got})
    count = lambda p: sum(r.delivery_point_natural_id == p for r in got)
    assert (count("P1"), count("P2")) == (48 + 46 + 48, 24)
    assert {r.covering_run_ids for r in got} == {"r1,r2"} and {r.covering_runs for r in got} == {2}


def test_gaps_are_filled_with_nulls(spark):
    df = spark.createDataFrame([("a", datetime(2026, 1, 1, 0, 0), 1), ("a", datetime(2026, 1, 1, 2, 0), 2)], "k string, t timestamp_ntz, v int")
    assert [r.v for r in spine.gap_filled(df, ["k"], "t").orderBy("t").collect()] == [1, None, None, None, 2]


def test_relations(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", "z")], "k int, v string, w string")
    changes = relations.compared(base, new, ["k"])
    assert {r.k: r.change for r in changes.collect()} == {1: "unchanged", 2: "update", 3: "delete", 4: "insert"}
    assert sorted(map(str, relations.applied(base, new, changes, ["k"]).collect())) == sorted(map(str, new.collect()))
    assert relations.profile(new, ["k"], "v").first().content_sum == relations.profile(new.orderBy(F.desc("k")).repartition(3), ["k"], "v").first().content_sum
    rows = spark.createDataFrame([("i", "p", 2), ("i", "p", 1), ("j", "p", 3), ("j", "q", 4)], "i string, p string, line int")
    assert {r.line: r.duplicate_class for r in relations.resolved_duplicates(rows, ["i"], "p", "line").collect()} == {1: "accepted", 2: "replay", 3: "conflict", 4: "conflict"}
    few = relations.newest(spark.range(5), 3, [F.desc("id")]).collect()
    assert [(r.id, r.truncated) for r in few] == [(4, True), (3, True), (2, True)]
    last = relations.page(spark.range(5), [F.asc("id")], 2, 3).collect()
    assert [(r.id, r.total_rows) for r in last] == [(3, 5), (4, 5)]
