"""Two-level scans against one window, blocks against plain ranges, versions in force against a product."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from calorant.operators import asof, dyadic, ranges, scans, temporal

T0 = datetime(2026, 1, 1)
HOUR = timedelta(hours=1)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_scans_in_parts_equal_one_window(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("aaaaaab") if rng.random() < 0.97 else None, i if rng.random() < 0.98 else None, rng.randint(0, 50) if rng.random() < 0.8 else None, i) for i in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t int, x int, id int").repartition(3)
    columns = {"most": scans.max_before(F.col("x")), "total": scans.sum_upto(F.col("x")), "large": scans.count_upto(F.col("x") > 20), "held": scans.last_upto(F.col("x")), "before": scans.previous(F.col("x")), "after": scans.following(F.col("x"))}
    want = scans.scanned(df, ["g"], ["t", "id"], columns)
    assert rows_of(scans.scanned(df, ["g"], ["t", "id"], columns, parts)) == rows_of(want)
    assert scans.scanned(df.limit(0), ["g"], ["t", "id"], columns, parts).collect() == []


def test_blocks_hold_each_number_of_a_range_once(spark):
    rng = random.Random(1)
    levels = dyadic.levels_of(500)
    rows = [(i, *sorted((rng.randint(0, 500), rng.randint(0, 501)))) for i in range(150)] + [(900, None, 5), (901, 7, 7), (902, 0, 501)]
    df = spark.createDataFrame(rows, "id int, lo long, hi long")
    for r in df.withColumn("b", dyadic.blocks("lo", "hi", levels)).collect():
        covered = [x for b in r.b for x in range(b.place * 4**b.level, (b.place + 1) * 4**b.level)]
        assert sorted(covered) == list(range(r.lo or 0, r.hi if r.lo is not None else 0)) and len(r.b) <= 6 * (levels + 1)
    points = spark.createDataFrame([(i,) for i in range(501)], "at long")
    got = sorted((r.at, r.id) for r in dyadic.held(points, df, [], "at", "lo", "hi", levels).collect())
    assert got == sorted((t, i) for t in range(501) for i, a, b in rows if a is not None and a <= t < b)


def made(rng, n, disjoint=False):
    """Versions (key, start, end, name), with open, empty and null ones, and rows (key, at, until)."""
    versions = []
    for i in range(n):
        a = T0 + HOUR * (3 * i if disjoint else rng.randint(0, 60))
        b = a + HOUR * (3 if disjoint else rng.choice([0, 1, 4, 30, -2]))
        versions.append((rng.choice(["k", "k", "l", None]) if not disjoint else "k", a if rng.random() < 0.95 or disjoint else None, b if disjoint or rng.random() < 0.8 else None, f"v{i}"))
    rows = [(i % 25, rng.choice(["k", "k", "l", "m", None]), T0 + HOUR * rng.randint(-5, 70) if rng.random() < 0.95 else None, rng.randint(0, 3)) for i in range(60)]
    return versions, [(i, k, t, None if t is None else t + HOUR * n) for i, k, t, n in rows]


def product(rows, versions, inside):
    out = []
    for i, k, t, u in rows:
        found = [v for v in versions if k is not None and v[0] == k and t is not None and v[1] is not None and inside(t, u, v[1], v[2])]
        out += [(i, k, t, u, v[3]) for v in found] or [(i, k, t, u, None)]
    return sorted(map(str, out))


VERSIONS, ROWS = "key string, a timestamp_ntz, b timestamp_ntz, name string", "id int, key string, t timestamp_ntz, u timestamp_ntz"


@pytest.mark.parametrize(("seed", "disjoint", "parts"), [(1, False, None), (2, False, 6), (3, True, None), (4, True, 4)])
def test_versions_in_force_equal_a_product(spark, seed, disjoint, parts):
    versions, rows = made(random.Random(seed), 40, disjoint)
    v, r = spark.createDataFrame(versions, VERSIONS), spark.createDataFrame(rows, ROWS)
    at = ranges.effective_join(r, v, ["key"], "a", "b", "t", parts=parts).select("id", "key", "t", "u", "name")
    assert sorted(str(tuple(x)) for x in at.collect()) == product(rows, versions, lambda t, u, a, b: a <= t and (b is None or t < b))
    over = ranges.effective_join(r, v, ["key"], "a", "b", "t", "u", parts=parts).select("id", "key", "t", "u", "name")
    assert sorted(str(tuple(x)) for x in over.collect()) == product(rows, versions, lambda t, u, a, b: a <= t and (b is None or u <= b))
    inner = ranges.effective_join(r, v, ["key"], "a", "b", "t", how="inner", parts=parts).select("id", "key", "t", "u", "name")
    assert sorted(str(tuple(x)) for x in inner.collect()) == [x for x in product(rows, versions, lambda t, u, a, b: a <= t and (b is None or t < b)) if not x.endswith("None)")]
    n = {x.active for x in asof.active(r, v, ["key"], "a", "b", "t", parts).collect()}
    assert max(n) == (1 if disjoint else max(n)) and min(n) == 0


def test_a_key_of_many_versions_makes_no_product(spark):
    """10,000 nested and disjoint versions of one key: the pairs made are the answers."""
    n = 10_000
    versions = spark.range(n).selectExpr("'k' AS key", "timestamp_ntz'2026-01-01' + make_dt_interval(0, int(id)) AS a", "timestamp_ntz'2026-01-01' + make_dt_interval(0, int(id) + 1 + int(id % 3)) AS b", "id AS name")
    rows = spark.range(n).selectExpr("id", "'k' AS key", "timestamp_ntz'2026-01-01' + make_dt_interval(0, int(id), 30) AS t")
    levels = dyadic.levels_of(2 * n)
    assert versions.selectExpr("bigint(name) AS lo", "bigint(name) + 5000 AS hi").select(F.max(F.size(dyadic.blocks("lo", "hi", levels)))).first()[0] <= 6 * (levels + 1)
    got = ranges.effective_join(rows, versions, ["key"], "a", "b", "t").cache()
    assert got.count() == sum(v <= k <= v + v % 3 for k in range(n) for v in range(max(0, k - 2), k + 1))
    assert got.where("name = 4711").count() == 1 + 4711 % 3


def test_open_and_long_ranges_enter_few_blocks(spark):
    points = spark.range(500).selectExpr("id", "timestamp_ntz'2020-01-01' + make_dt_interval(int(id) * 8) AS t")
    spans = spark.createDataFrame([(1, T0.replace(year=2010), None), (2, T0.replace(year=2021), T0.replace(year=2031)), (3, T0.replace(year=2022), T0.replace(year=2022)), (4, None, None), (5, T0.replace(year=2050), None)], "n int, a timestamp_ntz, b timestamp_ntz")
    got = sorted((r.id, r.n) for r in ranges.containment_join(points, spans, "t", "a", "b").collect())
    at = {r.id: r.t for r in points.collect()}
    want = sorted((i, n) for i, t in at.items() for n, a, b in ((1, 2010, None), (2, 2021, 2031)) if t >= datetime(a, 1, 1) and (b is None or t < datetime(b, 1, 1)))
    assert got == want


@pytest.mark.parametrize("parts", [None, 5])
def test_overlaps_are_counted_without_pairs(spark, parts):
    versions, _ = made(random.Random(9), 50)
    versions = [v for v in versions if v[0]]
    df = spark.createDataFrame(versions, VERSIONS)
    end = lambda v: v[2] or datetime(9999, 12, 31)
    sound = lambda v: v[1] is not None and v[1] < end(v)
    want = sorted((v[3], sum(sound(w) and w is not v and w[0] == v[0] and v[1] < end(w) and w[1] < end(v) for w in versions) if sound(v) else 0) for v in versions)
    assert sorted((r.name, r.overlaps) for r in ranges.overlap_counts(df, ["key"], "a", "b", "name", parts).collect()) == want


def test_histories_in_parts_equal_one_window(spark):
    rng = random.Random(4)
    log = [("k" if i % 9 else "l", rng.randint(1, 40), T0 + HOUR * rng.randint(0, 300), rng.choice(["provisional", "final", "withdrawn"]), f"s{rng.randint(0, 2)}", i) for i in range(300)]
    df = spark.createDataFrame(log, "key string, rev int, at timestamp_ntz, status string, state string, tie int")
    for make in (lambda p: temporal.knowledge_history(df, ["key"], "rev", F.col("at"), "tie", p), lambda p: temporal.capacity_history(df, ["key"], "rev", F.col("at"), "tie", "status", p), lambda p: temporal.coalesce_states(df, ["key"], ["at", "tie"], "state", p)):
        cols = make(None).columns
        assert rows_of(make(6).select(*cols)) == rows_of(make(None).select(*cols))
