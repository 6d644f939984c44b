"""Queries of paging, scope, schedule, clocks, boundaries and streams on the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorant.functions.calendar import local_time, offset_minutes
from calorant.operators import relations, temporal
from calorant.plans.analogues import read
from calorant.plans.folders import settled, shared_folder
from calorant.plans.registry import query


@query("""WITH t AS (SELECT count(*) AS total_rows FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 50 OFFSET 5000000000)
SELECT o_orderkey, o_custkey, total_rows FROM t LEFT JOIN r ON true""")
def q41_page_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    return relations.page(rows, [F.asc("o_orderkey")], number=100_000_001, size=50)


@query("""SELECT c_nationkey, c_mktsegment, o_custkey, CAST(min(o_orderdate) AS DATE) AS minimum_reporting_date, CAST(max(o_orderdate) AS DATE) AS maximum_reporting_date FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment <> 'BUILDING' AND c_nationkey IN (1, 5, 9) GROUP BY ALL""")
def q42_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.plans.product import context_tree

    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("day", F.to_date("o_orderdate"))
    return context_tree(rows, F.col("c_mktsegment") != "BUILDING", "c_nationkey", [1, 5, 9], ["c_nationkey", "c_mktsegment", "o_custkey"], "day")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def q43_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.nearest_ranks(read(spark, sf_dir, "events"), ["event_type"], "value", [50, 95, 99], parts=8)


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), i AS (SELECT o_orderkey, d, timezone('UTC', timezone('Europe/London', CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR)) AS a, CASE o_orderkey % 7 WHEN 0 THEN 13 ELSE 12 END AS h, CASE o_orderkey % 5 WHEN 0 THEN 2 ELSE 1 END AS n FROM d),
j AS (SELECT *, timezone('UTC', timezone('Europe/London', CAST(d + n AS TIMESTAMP) + to_hours(h))) AS b, CASE WHEN h = 13 THEN 'not_local_noon' WHEN n = 2 THEN 'days_not_consecutive' WHEN d < DATE '1996-01-01' THEN 'before_first_day' END AS issue FROM i)
SELECT o_orderkey, a, b, issue, CASE WHEN issue IS NULL THEN d END AS operating_date, CASE WHEN issue IS NULL THEN 'daily__' || strftime(d, '%Y%m%d') END AS trigger_run_id, CASE WHEN issue IS NULL THEN timezone('UTC', timezone('Europe/London', CAST(d + 1 AS TIMESTAMP) + INTERVAL 16 HOUR)) END AS expected_ready_by_utc FROM j""")
def q44_daily_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.functions.calendar import utc_time
    from calorant.plans.schedule import daily_requests

    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    at = lambda d, h: utc_time(d.cast("timestamp_ntz") + F.make_dt_interval(hours=h))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", at(day, F.lit(12)).alias("a"), at(F.date_add(day, F.when(key % 5 == 0, 2).otherwise(1)), F.when(key % 7 == 0, 13).otherwise(12)).alias("b"))
    return daily_requests(rows, "a", "b", first_day="1996-01-01")


@query("SELECT event_id, timezone('Europe/London', timezone('UTC', ts)) AS wall, CAST(date_diff('minute', ts, timezone('Europe/London', timezone('UTC', ts))) AS INTEGER) AS offset_minutes FROM events")
def q45_london_wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").select("event_id", local_time(ts).alias("wall"), offset_minutes(ts).alias("offset_minutes"))


@query("""SELECT i.l_orderkey, i.l_linenumber, CAST(s.l_quantity AS DECIMAL(18,6)) AS opening, CAST(e.l_quantity AS DECIMAL(18,6)) AS closing, CASE WHEN e.l_quantity IS NULL THEN 'boundary_missing' WHEN s.l_returnflag = 'A' OR e.l_returnflag = 'A' THEN 'boundary_withdrawn' WHEN e.l_quantity < s.l_quantity THEN 'negative_delta'
 WHEN e.l_quantity - s.l_quantity > 30 THEN 'implausible_delta' ELSE 'accepted' END AS delivery_status FROM lineitem i LEFT JOIN lineitem s ON s.l_orderkey = i.l_orderkey AND s.l_linenumber = i.l_linenumber LEFT JOIN lineitem e ON e.l_orderkey = i.l_orderkey AND e.l_linenumber = i.l_linenumber + 1""")
def q46_boundary_self_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals joined with the readings at both ends: the same readings twice, by order and line."""
    from calorant.functions.measures import delivery_status

    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,6)").alias("value"), F.when(F.col("l_returnflag") == "A", "withdrawn").otherwise("active").alias("status"))
    end = lambda n, shift: lines.select("l_orderkey", (F.col("l_linenumber") - shift).alias("l_linenumber"), F.col("value").alias(f"{n}_value"), F.col("status").alias(f"{n}_status"))
    rows = lines.select("l_orderkey", "l_linenumber").join(end("s", 0), ["l_orderkey", "l_linenumber"], "left").join(end("e", 1), ["l_orderkey", "l_linenumber"], "left")
    reading = lambda n: {"id": F.col(f"{n}_value"), "status": F.col(f"{n}_status"), "method": F.lit("actual"), "unit": F.lit("MWh_th"), "value": F.col(f"{n}_value")}
    said = delivery_status(F.col("l_orderkey"), reading("s"), reading("e"), F.lit("MWh_th"), F.lit(30))
    return rows.select("l_orderkey", "l_linenumber", F.col("s_value").alias("opening"), F.col("e_value").alias("closing"), said.alias("delivery_status"))


VERSIONS = """SELECT o_custkey, o_orderpriority, o_orderdate AS known_from_utc, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS known_to_utc, o_orderdate - INTERVAL 30 DAY AS effective_from_utc, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 400 DAY END AS effective_to_utc FROM orders"""


@query(f"""WITH h AS ({VERSIONS}), a AS (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 1 DAY AS t, o_orderdate - INTERVAL 10 DAY AS b, o_orderdate AS e FROM orders)
SELECT a.*, h.o_orderpriority AS version_priority FROM a LEFT JOIN h ON h.o_custkey = a.o_custkey AND known_from_utc <= t AND (known_to_utc IS NULL OR t < known_to_utc) AND effective_from_utc <= b AND (effective_to_utc IS NULL OR e <= effective_to_utc)""")
def q47_bitemporal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    days = lambda n: F.make_dt_interval(days=F.lit(n))
    orders = read(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp_ntz"))
    later = F.lead("d").over(Window.partitionBy("o_custkey").orderBy("d", "o_orderkey"))
    versions = orders.select("o_custkey", F.col("o_orderpriority").alias("version_priority"), F.col("d").alias("known_from_utc"), later.alias("known_to_utc"), (F.col("d") - days(30)).alias("effective_from_utc"), F.when(F.col("o_orderkey") % 3 == 0, F.col("d") + days(400)).alias("effective_to_utc"))
    asked = orders.select("o_orderkey", "o_custkey", (F.col("d") + days(1)).alias("t"), (F.col("d") - days(10)).alias("b"), F.col("d").alias("e"))
    return temporal.bitemporal_join(asked, versions, ["o_custkey"], "b", "e", "t")


@query("""WITH p AS (SELECT l_orderkey, l_partkey, l_shipdate AS t FROM lineitem) SELECT DISTINCT p.l_orderkey, q.t FROM p JOIN (SELECT ps.l_partkey, o.o_orderdate AS t FROM p ps JOIN orders o ON o.o_orderkey = ps.l_orderkey) q ON q.l_partkey = p.l_partkey UNION SELECT l_orderkey, t FROM p""")
def q48_related_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants at which an order or any order that shares a part with it changed: a join that expands by relationship."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_shipdate").alias("t"))
    clocks = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("t"))
    return temporal.related_points(lines, clocks, "l_orderkey", "l_partkey", "t")


@query("SELECT event_id, user_id, event_type, ts FROM events")
def q49_stream_append_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended by a stream that is started twice from one checkpoint; the second run adds nothing."""
    from calorant.streaming.windows import appended

    folder = shared_folder(spark, "append")
    for _ in range(2):
        source = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
        appended(source.select("event_id", "user_id", "event_type", "ts"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


PAYLOADS = """SELECT o_orderkey AS k, sha256(o_custkey || '|' || o_orderstatus) AS incoming, CASE WHEN o_orderkey % 4 <> 0 THEN sha256(CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE CAST(o_custkey AS VARCHAR) END || '|' || o_orderstatus) END AS held FROM orders"""


@query(f"SELECT k AS o_orderkey, CASE WHEN held IS NULL THEN 'new' WHEN held = incoming THEN 'replay' ELSE 'conflict' END AS load_class FROM ({PAYLOADS})")
def q50_load_classes_by_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_custkey", "o_orderstatus"), 256).alias("payload"))
    changed = F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_custkey").cast("string"))
    stored = read(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select("o_orderkey", F.sha2(F.concat_ws("|", changed, "o_orderstatus"), 256).alias("payload"))
    return relations.load_classes(rows, settled(stored, "stored"), "o_orderkey", "payload").select("o_orderkey", "load_class")


@query("""WITH i AS (SELECT CASE (l_orderkey + l_linenumber) % 11 WHEN 0 THEN ['empty_jsonl_line'] WHEN 1 THEN ['record_not_object'] WHEN 2 THEN ['duplicate_json_key'] WHEN 3 THEN ['schema_validation_failed'] WHEN 4 THEN ['interval_not_30_minutes']
 WHEN 5 THEN ['capacity_arithmetic_mismatch'] WHEN 6 THEN ['interval_not_30_minutes', 'capacity_arithmetic_mismatch'] WHEN 7 THEN ['invalid_json'] WHEN 8 THEN ['payload_not_canonical_json', 'schema_validation_failed'] ELSE [NULL] END AS codes FROM lineitem),
c AS (SELECT unnest(codes) AS code FROM i) SELECT 'delivery_point_capacity_assessment' AS feed, CASE WHEN code IS NULL THEN 'accepted' ELSE 'quarantined' END AS outcome, code, count(*) AS rows FROM c GROUP BY ALL""")
def q51_validation_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made of every order line, faulty by its numbers, through the file, schema, duplicate and row passes."""
    from calorant.plans import validation
    from calorant.sources.contracts import CONTRACTS

    feed, kind = "delivery_point_capacity_assessment", (F.col("l_orderkey") + F.col("l_linenumber")) % 11
    ceiling, held = F.col("l_quantity").cast("decimal(12,6)"), F.col("l_linenumber").cast("decimal(12,6)")
    left = F.greatest(ceiling - held, F.lit(0).cast("decimal(12,6)")) + F.when(kind.isin(5, 6), 1).otherwise(0)
    number = lambda c: F.when(kind == 3, "1.5").otherwise(c.cast("decimal(14,6)").cast("string"))
    name = F.concat_ws("-", F.lit("DP"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(14,2)").cast("string"))
    same = {"source_schema_id": feed, "source_schema_version": "1.0.0", "source_system_id": "s", "revision_type": "original", "published_at_utc": "2026-08-01T00:00:00Z", "approval_state": "approved", "approved_at_utc": "2026-08-01T00:00:00Z", "approved_by": "ops", "assessment_status": "final", "quantity_unit": "MWh_th",
            "assessment_method": "m", "assessment_method_version": "1", "capacity_reason_code": "normal", "finalized_at_utc": "2026-08-01T00:00:00Z", "interval_start_utc": "2026-08-26T00:00:00Z"}
    own = {"synthetic_data": F.lit(True), "source_revision": F.lit(1), "source_capacity_revision_id": name, "delivery_point_natural_id": name, "interval_end_utc": F.when(kind.isin(4, 6), "2026-08-26T01:00:00Z").otherwise("2026-08-26T00:30:00Z"),
           "nameplate_ceiling_mwh_th": number(ceiling), "operational_restriction_mwh_th": number(held), "deliverable_capacity_mwh_th": number(left)}
    sound = F.to_json(F.struct(*(F.lit(v).alias(n) for n, v in same.items()), *(c.alias(n) for n, c in own.items())))
    line = F.when(kind == 0, "").when(kind == 1, "[1]").when(kind == 2, '{"a": 1, "a": 2}').when(kind == 7, '{"a": NaN}').when(kind == 8, F.concat(F.lit('{"a": 1e400, '), F.substring(sound, 2, 1 << 20))).otherwise(sound)
    contract = CONTRACTS[feed]
    cell = [f.name for f in contract.fields if f.name.startswith("interval_") or f.name in validation.READ]
    df = settled(validation.parsed(read(spark, sf_dir, "lineitem").select(name.alias("locator"), line.alias("line")), feed, contract).select("locator", "identity", "payload_sha256", "issues", "replay", "unread", contract.opaque, *cell), feed)
    df = validation.local(validation.opaque_once(validation.unduplicated(df), contract.opaque), feed)
    outcome = F.when(F.size("issues") > 0, "quarantined").when(F.col("replay"), "replay").otherwise("accepted")
    return validation.report({feed: df.withColumn("outcome", outcome)})
