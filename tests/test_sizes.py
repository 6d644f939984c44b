"""What large tables need: nothing is written or dealt out as often as there are answers, and no task gets all of a table."""

from pyspark.sql import functions as F

from calorant.operators import asof, dyadic, ranges


def _at(minutes):
    return F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def _versions_and_rows(spark, copies=1):
    n = F.col("id")
    versions = spark.range(40).select((n % 2).alias("k"), n.alias("version"), _at(n * 3).alias("a"), F.when(n % 10 != 7, _at(n * 3 + 1 + n % 17)).alias("b"))
    rows = spark.range(200 * copies).select((n % 3).alias("k"), n.alias("row"), _at(n % 200).alias("t"))
    return versions, rows


def test_answers_of_many_versions_are_not_written(spark, monkeypatch):
    """F1."""
    versions, rows = _versions_and_rows(spark)
    written = []
    monkeypatch.setattr(asof, "settled", lambda df, purpose, own=asof.settled: written.append(purpose) or own(df, purpose))
    for parts in (None, 4):
        got = asof.joined(rows, versions, ["k"], "a", "b", "t", parts=parts)
        v = versions.withColumnRenamed("k", "vk")
        truth = rows.join(v, (F.col("k") == F.col("vk")) & (F.col("a") <= F.col("t")) & (F.col("b").isNull() | (F.col("t") < F.col("b"))), "left")
        assert sorted((r.row, -1 if r.version is None else r.version) for r in got.collect()) == sorted((r.row, -1 if r.version is None else r.version) for r in truth.collect())
    assert set(written) == {"versions", "events", "spans"}


def test_rows_of_one_instant_meet_versions_once(spark, monkeypatch):
    """F1."""
    points = []
    monkeypatch.setattr(dyadic, "held", lambda p, *more, own=dyadic.held: points.append(p.count()) or own(p, *more))
    for copies in (1, 3):
        versions, rows = _versions_and_rows(spark, copies)
        asof.joined(rows, versions, ["k"], "a", "b", "t").count()
    assert points[0] and points[1] <= 2 * 200  # two keys have versions


def test_bitemporal_join_sends_no_side_to_the_driver(spark, monkeypatch):
    """and rows that keep none of many versions, or of few, come once."""
    from calorant.operators import temporal

    n = F.col("id")
    versions = spark.range(60).select((n % 3).alias("k"), n.alias("version"), _at(n * 2).alias("known_from_utc"), F.when(n % 4 != 1, _at(n * 2 + 9)).alias("known_to_utc"), _at(n - 5).alias("effective_from_utc"), F.when(n % 5 != 2, _at(n + n % 30)).alias("effective_to_utc"))
    rows = spark.range(150).select((n % 4).alias("k"), n.alias("row"), F.when(n % 31 != 7, _at(n % 80)).alias("b"), _at(n % 80 + n % 7).alias("e"), _at(n * 3 % 140).alias("t"))
    v = versions.withColumnRenamed("k", "vk")
    inside = "k = vk and effective_from_utc <= b and (effective_to_utc is null or e <= effective_to_utc and b <= effective_to_utc) and known_from_utc <= t and (known_to_utc is null or t < known_to_utc)"
    truth = sorted((r.row, -1 if r.version is None else r.version) for r in rows.join(v, F.expr(inside), "left").collect())
    written = []
    monkeypatch.setattr(asof, "settled", lambda df, purpose, own=asof.settled: written.append(df) or own(df, purpose))
    for many in (1024, 3):
        monkeypatch.setattr(asof, "MANY", many, raising=False)
        got = temporal.bitemporal_join(rows, versions, ["k"], "b", "e", "t")
        assert sorted((r.row, -1 if r.version is None else r.version) for r in got.collect()) == truth
        assert not [df for df in [got, *written] if "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()]


def test_versions_of_one_span_are_found_once(spark, monkeypatch):
    """neither copies of versions nor of rows make more of what is dealt out by blocks, and rows aren't written."""
    met, written = [], []
    monkeypatch.setattr(dyadic, "held", lambda p, r, *more, own=dyadic.held: met.append((p.count(), r.count())) or own(p, r, *more))
    monkeypatch.setattr(asof, "settled", lambda df, purpose, own=asof.settled: written.append(own(df, purpose)) or written[-1])
    for copies in (2, 6):
        versions, rows = _versions_and_rows(spark)
        copied = lambda df, name: df.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).withColumn(name, F.col(name) + 1000 * F.col("copy")).drop("copy")
        got = asof.joined(copied(rows, "row"), copied(versions, "version"), ["k"], "a", "b", "t", parts=3)
        one = asof.joined(rows, versions, ["k"], "a", "b", "t")
        count = lambda df: df.agg(F.count("version"), F.count_if(F.col("version").isNull())).first()
        (pairs, none), (pairs_of_one, none_of_one) = count(got), count(one)
        assert pairs == copies**2 * pairs_of_one and none == copies * none_of_one
    assert met[0] == met[2]
    assert not [df.columns for df in written if "_row" in df.columns]


def test_no_block_has_all_points(spark, monkeypatch):
    """F7."""
    most = []

    def spy(points, spans, keys, at, lo, hi, levels, own=dyadic.held):
        places = points.select(F.explode(dyadic.places(at, levels)).alias("p")).groupBy("p").count()
        most.append(places.agg(F.max("count")).first()[0])
        return own(points, spans, keys, at, lo, hi, levels)

    monkeypatch.setattr(dyadic, "held", spy)
    n = F.col("id")
    points = spark.range(1024).select(n.alias("point"), _at(n).alias("t"))
    asked = spark.range(5).select(n.alias("range"), _at(n * 200).alias("a"), F.when(n != 3, _at(n * 200 + 300)).alias("b"))
    got = ranges.containment_join(points, asked, "t", "a", "b")
    assert got.count() == 300 + 300 + 300 + 424 + 224
    assert most[0] <= 1024 // 64


def test_loads_write_hashes_as_bytes_and_replays_as_numbers(spark, tmp_path, monkeypatch):
    """F5."""
    from calorant.plans import load

    written = {}
    monkeypatch.setattr(load, "settled", lambda df, purpose, own=load.settled: written.setdefault(purpose, own(df, purpose)))
    hashed = lambda c: F.sha2(F.col(c).cast("string"), 256)
    rows = spark.range(50).select("id", hashed("id").alias(load.IDENTITY), F.sha2(F.concat(F.lit("p"), F.col("id").cast("string")), 256).alias(load.PAYLOAD))
    odd = rows.withColumn(load.IDENTITY, F.when(F.col("id") == 7, F.lit("b" * 31)).otherwise(F.col(load.IDENTITY)))
    assert load.load(odd.union(odd.where("id < 5")), str(tmp_path / "store")) == {"inserted": 50, "reused": 0}
    assert set(written) == {"incoming", "load"} and written["incoming"].select(F.max(F.length("_payload"))).first()[0] == 32
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "store")).select(*odd.columns).collect())) == sorted(map(tuple, odd.collect()))
    written.clear()
    assert load.load(odd, str(tmp_path / "store")) == {"inserted": 0, "reused": 50}
    assert written["load"].where("_id is not null or _row is not null").count() == 0


def test_instants_of_shared_relations_go_as_sets(spark):
    """F4."""
    from calorant.operators import temporal

    n = F.col("id")
    stamp = lambda k: F.lit("2023-12-30").cast("timestamp_ntz") + F.make_dt_interval(days=k.cast("int"), hours=F.when(k % 4 == 0, 5).otherwise(0))
    links = spark.range(60).select((n % 20).alias("o"), F.when(n % 7 != 0, n % 9).alias("p"), F.when(n % 11 != 0, stamp(n % 13)).alias("t"))
    clocks = spark.range(18).select(n.alias("o"), F.when(n != 4, stamp(n * 9000)).alias("t"))
    shared = links.select("o", "p").distinct()
    of = shared.join(clocks, "o").select("p", "t").distinct()
    truth = shared.join(of, "p").select("o", "t").union(links.select("o", "t")).distinct()
    got = temporal.related_points(links, clocks, "o", "p", "t")
    assert got.schema["t"].dataType == clocks.schema["t"].dataType
    assert sorted(got.collect(), key=str) == sorted(truth.collect(), key=str)


def test_only_hashes_of_shared_identities_are_written(spark, monkeypatch):
    """F6."""
    from calorant.plans import validation

    n, written = F.col("id"), []
    monkeypatch.setattr(validation, "settled", lambda df, purpose, own=validation.settled: written.append(own(df, purpose)) or written[-1])
    rows = spark.range(60).select(F.lpad(n.cast("string"), 4, "0").alias("locator"), F.when(n != 59, (n % 50).cast("string")).alias("identity"), (n % 7 * (n % 50 < 3).cast("int")).cast("string").alias("payload_sha256"), F.when(n == 5, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")).alias("issues"), F.lit(False).alias("replay"))
    for few in (20_000, 2):
        monkeypatch.setattr(validation, "FEW", few)
        got = {int(r.locator): r for r in validation.unduplicated(rows).collect()}
        assert {k for k, r in got.items() if r.issues == ["source_revision_conflict"]} == {0, 1, 2, 50, 51, 52}
        assert {k: r.accepted_locator for k, r in got.items() if r.replay} == {k: f"{k - 50:04d}" for k in (53, 54, 56, 57, 58)}
    assert [(df.columns, df.count()) for df in written] == [(["_hash"], 8)] * 2


def test_lines_are_read_once_into_fields(spark):
    """as objects() reads them, by whatever order of keys, and bytes that are no UTF-8 don't end the job."""
    from calorant.sources import jsonlines

    texts = ['{"b": 1.50, "a": "x"}', '{"a":"x","b":1.5}', '{"a": null, "z": {"y": [1, 1.0]}, "é": true}', '{"a": 1e400, "z": 2}', '{"a": "\\ud800", "b": -0}', '{"a": 1, "a": 2}', "", "[1]", "{", None, "{}"]
    lines = spark.createDataFrame(list(enumerate(texts)), "id int, line string").withColumn("line", F.when(F.col("id") == 10, F.expr("cast(X'7B2261223A22FF227D' as string)")).otherwise(F.col("line")))
    want = jsonlines.objects(lines).select("id", "issue", F.sha2("payload", 256), F.array_sort(F.array_except(F.map_keys("values"), F.array(F.lit("a"), F.lit("b")))), *(F.try_element_at("values", F.lit(k)) for k in "ab"))
    got = jsonlines.fields(lines, ["a", "b"]).select("id", "issue", "payload_sha256", "others", "_token_a", "_token_b")
    assert sorted(got.collect()) == sorted(want.collect())


def test_passes_write_cells_not_lines(spark, monkeypatch):
    """F3."""
    from calorant.plans import feed_queries, validation

    written = []
    monkeypatch.setattr(validation, "settled", lambda df, purpose="table", own=validation.settled: written.append(own(df, purpose)) or written[-1])
    assert feed_queries.q62_cross_feed_codes(spark, "/root/testdata/sf0.001").agg(F.sum("rows")).first()[0] > 0
    assert written and not [df.columns for df in written if {"line", "failures", "published_at_utc"} & set(df.columns)]


def test_rows_of_keys_with_one_version_are_not_counted_by_locator(spark, monkeypatch):
    """F3."""
    from calorant.plans import validation

    n, counted = F.col("id"), []
    monkeypatch.setattr(validation, "_counted", lambda df, *more, own=validation._counted: counted.append(df.count()) or own(df, *more))
    rows = spark.range(60).select(n.cast("string").alias("locator"), (n % 6).alias("k"), _at(n).alias("reading_at_utc"))
    one = spark.range(1, 5).select(n.alias("k"), _at(n * 5).alias("effective_from_utc"), F.when(n != 2, _at(n * 12)).alias("effective_to_utc"), (n * 10).alias("x"))
    more = one.where("k > 2").withColumns({"effective_from_utc": _at(F.col("k") * 10), "x": F.col("x") + 1})
    inside = F.expr("v.effective_from_utc <= l.reading_at_utc and (v.effective_to_utc is null or l.reading_at_utc < v.effective_to_utc)")
    for versions, asked in ((one, []), (one.union(more), [20])):
        truth = {str(k): [] for k in range(60)}
        for v in versions.collect():
            for r in rows.where(F.col("k") == v.k).collect():
                if v.effective_from_utc <= r.reading_at_utc and (v.effective_to_utc is None or r.reading_at_utc < v.effective_to_utc):
                    truth[r.locator].append(v.x)
        for few in (20_000, 1):
            monkeypatch.setattr(validation, "FEW", few)
            counted.clear()
            got = validation._covering(rows, versions, ["k"], ["x"], "v", inside).collect()
            assert sorted((r.locator, r.v_n, r.v_x) for r in got) == sorted((k, len(xs), max(xs, default=None)) for k, xs in truth.items()) and counted == asked


def test_outcomes_of_customers_with_several_versions(spark):
    """and rows in force are of an episode's greatest revision."""
    from calorant.plans import validation
    from test_validation import OK, run, world

    w, noon = world(), "2026-08-26T{}:00Z"
    customer, site, cell = w["customer_master"][0], w["industrial_site_master"][0], w["commitment_schedule"][0]
    w["customer_master"] = [customer | {"effective_to_utc": noon.format("05:00")}, customer | {"customer_version_id": "CV-2", "effective_from_utc": noon.format("06:00")}]
    w["industrial_site_master"] += [site | {"source_revision": 2, "revision_type": "business_change"}]
    w["commitment_schedule"] += [cell | {"source_commitment_revision_id": f"COM-{h}", "interval_start_utc": noon.format(f"0{h}:00"), "interval_end_utc": noon.format(f"0{h}:30")} for h in (4, 5, 6)]
    got, said = run(spark, w)
    gap = ("quarantined", ["customer_effective_coverage_missing"])
    assert said["commitment_schedule"] == [OK, OK, gap, OK] and said["industrial_site_master"] == [OK, OK] and said["customer_master"] == [OK, OK]
    lines = {feed: df.select("locator", "line") for feed, df in got.items()}
    for feed, df in validation.outcomes(lines).items():
        assert [(r.outcome, sorted(r.issues)) for r in df.orderBy("locator").collect()] == said[feed]
