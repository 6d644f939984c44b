"""Stores of loads, objects made once by many writers, digests, pages, ranks and stored types."""

from __future__ import annotations

import random
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from calorant.operators import digests, relations
from calorant.operators.conformance import conformance
from calorant.plans import load as loading
from calorant.plans.load import LoadConflict, load, publish_coverage
from calorant.sources.objects import ImmutableConflict, get, put_if_absent


def at_once(n, work):
    """What n threads return or raise that start together."""
    gate, out = threading.Barrier(n), [None] * n

    def run(k):
        gate.wait()
        try:
            out[k] = work(k)
        except Exception as e:
            out[k] = type(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_one_of_many_writers_makes_an_object(spark, tmp_path):
    path = f"{tmp_path}/a/object"
    assert get(spark, path) is None
    assert sorted(at_once(8, lambda k: put_if_absent(spark, path, b"\x00\xffsame"))) == ["created"] + ["reused"] * 7
    assert get(spark, path) == b"\x00\xffsame"
    with pytest.raises(ImmutableConflict):
        put_if_absent(spark, path, b"other")
    said = at_once(6, lambda k: put_if_absent(spark, f"{tmp_path}/b", b"%d" % k))
    assert said.count("created") == 1 and said.count(ImmutableConflict) == 5
    assert put_if_absent(spark, f"{tmp_path}/empty", b"") == "created" and get(spark, f"{tmp_path}/empty") == b""
    assert not [f.name for f in tmp_path.iterdir() if f.name.startswith((".b.", ".empty."))]


def test_one_of_many_writers_publishes_a_run(spark, tmp_path):
    path = f"{tmp_path}/coverage"
    run = lambda rows, at: spark.createDataFrame([("r1", rows, None, at)], "run_id string, row_count int, note string, published_at_utc string")
    frames = [run(5, f"t{k}") for k in range(4)]
    said = at_once(4, lambda k: publish_coverage(frames[k], path, "run_id"))
    assert sorted(s["inserted"] for s in said) == [0, 0, 0, 1] and spark.read.parquet(path).count() == 1
    others = [run(k, "t") for k in (5, 6)]
    assert at_once(2, lambda k: publish_coverage(others[k], path, "run_id")) == [{"inserted": 0, "reused": 1}, LoadConflict]
    assert publish_coverage(frames[0].limit(0), path, "run_id") == {"inserted": 0, "reused": 0}


def test_a_small_load_reads_few_folders(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias(loading.IDENTITY), F.lit("p").alias(loading.PAYLOAD), F.col("id").cast("int").alias("v"))
    assert load(rows, path) == {"inserted": 3000, "reused": 0}
    few = rows.where("v in (5, 6)")
    scan = loading.held(spark, path, rows, few)
    scan.count()
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan and f"In({loading.IDENTITY}" in plan
    assert sorted(r.v for r in scan.collect()) == [5, 6]
    with pytest.raises(LoadConflict) as said:
        load(few.withColumn(loading.PAYLOAD, F.lit("q")), path)
    assert {d[1:] for d in said.value.detail} == {("q", "p")}
    twice = few.unionByName(few.withColumn(loading.PAYLOAD, F.lit("z")))
    with pytest.raises(LoadConflict):
        load(twice, f"{tmp_path}/other")
    assert load(rows.limit(0), path) == {"inserted": 0, "reused": 0}


@pytest.mark.parametrize("depth", [1, 2])
def test_digests_find_what_differs(spark, tmp_path, depth):
    rng = random.Random(depth)
    base = [(k, rng.choice(["x", None, "null"]), k % 7) for k in range(600)]
    following = [(k, v if k % 97 else "changed", n) for k, v, n in base if k % 113 != 5] + [(1000, "new", 1)]
    schema = "k int, v string, n int"
    for rows, name in ((base, "a"), (following, "b"), (base[::-1], "c")):
        digests.publish(spark.createDataFrame(rows, schema), ["k"], f"{tmp_path}/{name}", depth)
    pair = f"{tmp_path}/a", f"{tmp_path}/b"
    got = {r.k: r.change for r in digests.changes(spark, *pair, ["k"], depth).collect()}
    want = {k: "update" for k, v, _ in base if not k % 97 and v != "changed"} | {k: "delete" for k, *_ in base if k % 113 == 5} | {1000: "insert"}
    assert got == want
    leaves = digests.differing(spark, *pair, depth)
    assert 0 < len(leaves) <= len(want) and digests.rows_of(spark, pair[0], leaves).count() < 600
    assert digests.differing(spark, pair[0], f"{tmp_path}/c", depth) == [] and digests.changes(spark, pair[0], f"{tmp_path}/c", ["k"], depth).count() == 0
    root = spark.read.parquet(f"{tmp_path}/a/tree").where("level = 0").first()
    assert root.rows == 600


def test_digests_see_repeated_rows_and_nulls(spark):
    rows = lambda *r: [tuple(x) for x in digests.tree(spark.createDataFrame(list(r), "k int, v string"), ["k"]).where("level = 0").select(*digests.WORDS).collect()]
    assert len({str(rows(*r)) for r in ([(1, "a")], [(1, "a"), (1, "a")], [(1, None)], [(1, "null")], [(1, "")])}) == 5
    assert digests.tree(spark.createDataFrame([], "k int, v string"), ["k"]).count() == 0


@pytest.mark.parametrize("number", [1, 2, 9, 33, 40, 41, 5_000_000_000])
def test_pages_are_located_by_ranges(spark, number):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(30)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "x int, id int").repartition(3)
    order = [F.desc_nulls_last("x"), F.asc("id")]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))[(number - 1) * 10 : number * 10]
    got = [tuple(r) for r in relations.page(df, order, number, 10, most=15, parts=6).collect()]
    assert sorted(got, key=str) == sorted([(*r, 400) for r in want] or [(None, None, 400)], key=str)


def test_pages_of_nothing_and_wrong_sizes(spark):
    empty = spark.createDataFrame([], "x int")
    for number in (1, 9):
        assert [tuple(r) for r in relations.page(empty, [F.asc("x")], number, 10, most=15).collect()] == [(None, 0)]
    for number, size in ((0, 5), (1, 0), (1, 16)):
        with pytest.raises(ValueError):
            relations.page(empty, [F.asc("x")], number, size, most=15)


@pytest.mark.parametrize("parts", [None, 7])
def test_nearest_ranks_equal_sorting(spark, parts):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[rng.randint(0, 40) / 4 for _ in range(5)]])) for _ in range(500)] + [("void", None), ("one", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    percents = [1, 50, 95, 100]

    def rank(values, p):
        values = sorted(v for v in values if v is not None)
        return values[-(-len(values) * p // 100) - 1] if values else None

    want = {g: tuple(rank([x for h, x in rows if h == g], p) for p in percents) for g in {g for g, _ in rows}}
    assert {r[0]: tuple(r)[1:] for r in relations.nearest_ranks(df, ["g"], "x", percents, parts).collect()} == want
    assert tuple(relations.nearest_ranks(df, [], "x", percents, parts).first()) == tuple(rank([x for _, x in rows], p) for p in percents)


def test_stored_types_against_declared_ones(spark):
    rows = [(Decimal("1.250"), 12.5, "x", 7, float("inf")), (Decimal("99.999"), 1234.0, "y", 120, 1e300), (None, 0.001, None, None, 0.1)]
    df = spark.createDataFrame(rows, "a decimal(10,3), b double, c string, d int, e double")
    got = {r.column_name: tuple(r)[1:] for r in conformance(df, {"a": (4, 2), "b": (5, 2), "c": (3, 1), "d": (2, 0), "gone": (1, 0), "e": (9, 3)}).collect()}
    assert got["a"] == ("decimal(10,3)", "decimal(4,2)", "wider", 3, 1, 1, 1)  # 99.999 becomes 100.00
    assert got["b"] == ("double", "decimal(5,2)", "inexact", 3, 0, 1, 1)
    assert got["c"] == ("string", "decimal(3,1)", "not_numeric", None, None, None, None) and got["gone"][:1] == (None,) and got["gone"][2] == "missing"
    assert got["d"] == ("int", "decimal(2,0)", "inexact", 3, 1, 0, 1) and got["e"][3:] == (3, 0, 2, 2)
    assert conformance(df, {"a": (10, 3)}).first().state == "exact" and conformance(df, {"a": (11, 3)}).first().state == "narrower"
