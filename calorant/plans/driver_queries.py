"""The operators on the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorant.functions.keys import state_fingerprint, surrogate_key
from calorant.functions.measures import REVISIONS, interval_results, to_mwh
from calorant.operators import ranges, relations, spine, temporal
from calorant.plans.analogues import INTERVAL_INPUTS, ORDER_VERSIONS, REVISION_LOG, interval_inputs, order_versions, read, revision_log
from calorant.plans.folders import settled, shared_folder
from calorant.plans.registry import query

IDENTITY = ["user_id", "event_type"]

HISTORY = f"""
WITH log AS ({REVISION_LOG}),
one AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY rev DESC, event_id DESC) = 1),
high AS (SELECT *, max(rev) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_max_revision FROM one),
history AS (SELECT user_id, event_type, event_id, rev, value, ts AS known_from_utc, prior_max_revision,
  lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS known_to_utc FROM high WHERE prior_max_revision IS NULL OR rev > prior_max_revision)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = revision_log(spark, sf_dir)
    return temporal.knowledge_history(log, IDENTITY, "rev", F.col("ts"), "event_id").drop("ts")


@query(f"WITH log AS ({REVISION_LOG}) SELECT user_id, event_type, event_id, rev, value FROM log QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY rev DESC, event_id DESC) = 1")
def q01_current_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = temporal.latest_revision(revision_log(spark, sf_dir), IDENTITY, [F.desc("rev"), F.desc("event_id")])
    return latest.select(*IDENTITY, "event_id", "rev", "value")


@query(HISTORY + " SELECT * FROM history")
def q02_record_high_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select(*IDENTITY, "event_id", "rev", "value", "known_from_utc", "prior_max_revision", "known_to_utc")


@query(f"""
WITH log AS (SELECT *, CASE WHEN rev % 10 < 6 THEN 'provisional' WHEN rev % 10 < 9 THEN 'final' ELSE 'withdrawn' END AS status FROM ({REVISION_LOG})),
one AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY rev DESC, event_id DESC) = 1),
high AS (SELECT *, max(rev) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM one),
kept AS (SELECT *, count(*) FILTER (WHERE status <> 'provisional') OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS settled FROM high WHERE prior IS NULL OR rev > prior)
SELECT user_id, event_id, rev, status, ts AS known_from_utc, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS known_to_utc FROM kept WHERE NOT (status = 'provisional' AND settled > 0)""")
def q03_capacity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("rev") % 10
    log = revision_log(spark, sf_dir).withColumn("status", F.when(kind < 6, "provisional").when(kind < 9, "final").otherwise("withdrawn"))
    history = temporal.capacity_history(log, ["user_id"], "rev", F.col("ts"), "event_id", "status")
    return history.select("user_id", "event_id", "rev", "status", "known_from_utc", "known_to_utc")


INSTANTS = ["2024-01-05 00:00:00", "2024-01-12 12:00:00", "2024-01-25 06:30:00"]


@query(HISTORY + f""", asked AS (SELECT DISTINCT user_id, event_type, CAST(t AS TIMESTAMP) AS t FROM events, (VALUES {", ".join(f"('{t}')" for t in INSTANTS)}) AS v(t))
SELECT a.user_id, a.event_type, a.t, h.rev, h.value, h.known_from_utc FROM asked a LEFT JOIN history h ON a.user_id = h.user_id AND a.event_type = h.event_type AND h.known_from_utc <= a.t AND (h.known_to_utc IS NULL OR a.t < h.known_to_utc)""")
def q04_as_known_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    instants = F.array(*(F.lit(t).cast("timestamp_ntz") for t in INSTANTS))
    asked = read(spark, sf_dir, "events").select(*IDENTITY).distinct().withColumn("t", F.explode(instants))
    return temporal.as_known_at(asked, _history(spark, sf_dir), IDENTITY, "t").select(*IDENTITY, "t", "rev", "value", "known_from_utc")


@query(HISTORY + """, wide AS (SELECT user_id, min(ts) AS known_from_utc FROM events WHERE event_type = 'click' GROUP BY user_id, date_trunc('day', ts))
SELECT user_id, known_from_utc FROM history UNION SELECT user_id, known_from_utc FROM wide""")
def q05_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = read(spark, sf_dir, "events").where("event_type = 'click'")
    wide = clicks.groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.min("ts").alias("known_from_utc")).drop("d")
    return temporal.change_points([_history(spark, sf_dir).select("user_id", "known_from_utc"), wide])


@query("""
WITH s AS (SELECT user_id, ts AS known_from_utc, event_id, sha256(length(b) || ':' || b) AS state_sha256 FROM (SELECT *, CAST(CAST(floor(value / 10) AS BIGINT) % 3 AS VARCHAR) AS b FROM events)),
c AS (SELECT *, lag(state_sha256) OVER (PARTITION BY user_id ORDER BY known_from_utc, event_id) AS p FROM s),
k AS (SELECT * FROM c WHERE p IS NULL OR p <> state_sha256)
SELECT user_id, event_id, known_from_utc, state_sha256, lead(known_from_utc) OVER (PARTITION BY user_id ORDER BY known_from_utc, event_id) AS known_to_utc FROM k""")
def q06_state_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = (F.floor(F.col("value") / 10).cast("long") % 3).cast("string")
    states = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("known_from_utc"), state_fingerprint(bucket).alias("state_sha256"))
    return temporal.coalesce_states(states, ["user_id"], ["known_from_utc", "event_id"], "state_sha256")


@query("""
WITH b AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS z FROM events),
g AS (SELECT event_type, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP) + INTERVAL 1430 MINUTE, INTERVAL 30 MINUTE)) AS interval_start_utc FROM b, (SELECT DISTINCT event_type FROM events)),
n AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS interval_start_utc, count(*) AS event_count FROM events GROUP BY ALL)
SELECT event_type, interval_start_utc, event_count FROM g LEFT JOIN n USING (event_type, interval_start_utc)""")
def q07_half_hour_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    span = events.groupBy("event_type").agg(F.lit(1).alias("one")).drop("one").join(F.broadcast(events.agg(F.min("day").alias("start_date_local_inclusive"), F.max("day").alias("end_date_local_inclusive"))))
    grid = spine.half_hour_grid(spine.local_days(span), "UTC").select("event_type", "interval_start_utc")
    slot = F.date_trunc("hour", "ts") + F.make_dt_interval(mins=(F.minute("ts").cast("int") / 30).cast("int") * 30)
    counts = events.groupBy("event_type", slot.alias("interval_start_utc")).agg(F.count("*").alias("event_count"))
    return grid.join(counts, ["event_type", "interval_start_utc"], "left")


@query(f"""
WITH v AS ({ORDER_VERSIONS})
SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, v.o_orderkey AS version_orderkey, v.effective_from_utc, v.effective_to_utc
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN v ON v.o_custkey = o.o_custkey AND v.effective_from_utc <= l.l_shipdate AND (v.effective_to_utc IS NULL OR l.l_shipdate < v.effective_to_utc)""")
def q08_effective_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(owner.hint("merge"), "l_orderkey")
    joined = ranges.effective_join(settled(lines, "lines"), order_versions(spark, sf_dir), ["o_custkey"], "effective_from_utc", "effective_to_utc", "l_shipdate")
    return joined.select("l_orderkey", "l_linenumber", "l_shipdate", F.col("o_orderkey").alias("version_orderkey"), "effective_from_utc", "effective_to_utc")


@query("""
WITH r AS (SELECT c_custkey AS range_id, TIMESTAMP '2024-01-01' + (c_custkey % 20) * INTERVAL 1 DAY AS a, TIMESTAMP '2024-01-01' + (c_custkey % 20) * INTERVAL 1 DAY + (1 + c_custkey % 5) * INTERVAL 13 HOUR AS b FROM customer WHERE c_custkey < 40)
SELECT range_id, event_type, count(*) AS events, sum(CAST(value AS DECIMAL(18,6))) AS total FROM events JOIN r ON ts >= a AND ts < b GROUP BY ALL""")
def q09_pure_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 20).cast("int"))
    versions = read(spark, sf_dir, "customer").where("c_custkey < 40").select(F.col("c_custkey").alias("range_id"), start.alias("a"), (start + F.make_dt_interval(hours=((1 + F.col("c_custkey") % 5) * 13).cast("int"))).alias("b"))
    joined = ranges.containment_join(read(spark, sf_dir, "events").select("ts", "event_type", "value"), versions, "ts", "a", "b")
    return joined.groupBy("range_id", "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))


@query("""
WITH r AS (SELECT c_custkey AS range_id, TIMESTAMP '2024-01-01' + (c_custkey % 20) * INTERVAL 1 DAY AS a, TIMESTAMP '2024-01-01' + (c_custkey % 20) * INTERVAL 1 DAY + (1 + c_custkey % 5) * INTERVAL 13 HOUR AS b FROM customer)
SELECT range_id, event_type, count(*) AS events, sum(CAST(value AS DECIMAL(18,6))) AS total FROM events JOIN r ON ts >= a AND ts < b GROUP BY ALL""")
def q09_whole_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 20).cast("int"))
    ranges_of = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("range_id"), start.alias("a"), (start + F.make_dt_interval(hours=((1 + F.col("c_custkey") % 5) * 13).cast("int"))).alias("b"))
    # many customers have one range: events are totalled once a range, and the customers joined to the totals
    joined = ranges.containment_join(read(spark, sf_dir, "events").select("ts", "event_type", "value"), ranges_of.select("a", "b").distinct(), "ts", "a", "b")
    totals = joined.groupBy("a", "b", "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))
    return ranges_of.join(totals, ["a", "b"]).select("range_id", "event_type", "events", "total")


@query(f"""
WITH r AS (SELECT user_id, event_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS register, event_type FROM ({REVISION_LOG})),
p AS (SELECT *, lag(register) OVER w AS opening, lag(event_type) OVER w AS opening_type FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT user_id, event_id, CAST(opening AS DECIMAL(28,6)) AS opening, CAST(register AS DECIMAL(28,6)) AS closing, CASE WHEN opening IS NULL THEN 'boundary_missing' WHEN event_type = 'error' OR opening_type = 'error' THEN 'non_actual_reading' WHEN register - opening < 0 THEN 'negative_delta' WHEN register - opening > 100 THEN 'implausible_delta' ELSE 'accepted' END AS delivery_status FROM p)
SELECT *, CASE WHEN delivery_status = 'accepted' THEN CAST(closing - opening AS DECIMAL(20,6)) END AS delivered_mwh FROM d""")
def q10_register_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    register = revision_log(spark, sf_dir).withColumn("closing", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(28,6)"))
    ends = register.withColumn("opening", F.lag("closing").over(w)).withColumn("opening_type", F.lag("event_type").over(w))
    delta = F.col("closing") - F.col("opening")
    status = F.when(F.col("opening").isNull(), "boundary_missing").when((F.col("event_type") == "error") | (F.col("opening_type") == "error"), "non_actual_reading").when(delta < 0, "negative_delta").when(delta > 100, "implausible_delta").otherwise("accepted")
    return ends.select("user_id", "event_id", "opening", "closing", status.alias("delivery_status")).withColumn("delivered_mwh", F.when(F.col("delivery_status") == "accepted", (F.col("closing") - F.col("opening")).cast("decimal(20,6)")))


def _kernel_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    one = {f"{r}_revision": F.lit(1) for r in REVISIONS if r not in ("commitment", "order")}
    return interval_inputs(spark, sf_dir).withColumns(one | {
        "commitment_revision": F.when(F.col("committed_mwh").isNotNull(), n), "schedule_status": F.lit("active"),
        "obligation_status": F.when(F.col("committed_mwh") > 3, "committed").otherwise("no_commitment"),
        "delivery_status": F.when(F.col("delivered_mwh").isNotNull(), "accepted").otherwise("boundary_missing"),
        "order_count": n % 3, "order_state": F.when(n % 3 == 1, F.when(n == 4, "cancelled").otherwise("approved")), "order_mwh": F.when(n % 3 == 1, F.lit("0.500000").cast("decimal(20,6)")), "order_revision": F.lit(1),
        "customer_version_id": F.col("l_suppkey"), "site_version_id": F.col("l_partkey"), "contract_terms_version_id": F.when(n != 6, F.col("l_suppkey")),
        "capacity_status": F.when(F.col("capacity_mwh").isNotNull(), "final"),
    }).withColumns({"energy_rate": F.when(n != 6, F.col("energy_rate")), "penalty_rate": F.when(n != 6, F.col("penalty_rate")), "committed_mwh": F.when(F.col("obligation_status") == "no_commitment", F.when(F.col("committed_mwh").isNotNull(), F.lit(0).cast("decimal(20,6)"))).otherwise(F.col("committed_mwh"))})


KERNEL = f"""
WITH i AS (SELECT *, l_linenumber AS n, CASE WHEN q IS NULL THEN NULL WHEN q > 3 THEN q ELSE 0 END AS c, CASE WHEN q > 3 THEN 'committed' ELSE 'no_commitment' END AS obligation FROM (SELECT *, committed_mwh AS q, delivered_mwh AS d, capacity_mwh AS cap FROM ({INTERVAL_INPUTS}))),
x AS (SELECT *, CASE WHEN c IS NULL THEN 'missing' ELSE obligation END AS commitment_status,
  CAST(CASE WHEN n % 3 = 0 THEN 0 WHEN n % 3 = 1 AND n <> 4 THEN 0.5 WHEN n % 3 = 1 THEN 0 END AS DECIMAL(20,6)) AS extra, n <> 6 AS contract FROM i),
y AS (SELECT *, CASE WHEN c IS NOT NULL AND d IS NOT NULL THEN greatest(c - d, 0) END AS shortfall, CASE WHEN c IS NOT NULL AND d IS NOT NULL THEN greatest(d - c, 0) END AS excess,
  CASE WHEN c IS NOT NULL AND d IS NOT NULL AND extra IS NOT NULL AND contract THEN least(d, c + extra) END AS billable,
  CASE WHEN c IS NOT NULL AND d IS NOT NULL AND extra IS NOT NULL THEN greatest(d - c - extra, 0) END AS unbilled FROM x),
z AS (SELECT *, CASE WHEN contract THEN CAST(CAST(billable AS DECIMAL(20,6)) * energy_rate AS DECIMAL(38,12)) END AS gross, CASE WHEN contract THEN CAST(CAST(shortfall AS DECIMAL(20,6)) * penalty_rate AS DECIMAL(38,12)) END AS penalty FROM y),
facts AS (SELECT l_orderkey, l_linenumber, l_suppkey, commitment_status, CAST(shortfall AS DECIMAL(20,6)) AS shortfall_mwh, CAST(excess AS DECIMAL(20,6)) AS excess_mwh, CAST(billable AS DECIMAL(20,6)) AS billable_mwh, CAST(unbilled AS DECIMAL(20,6)) AS unbilled_mwh,
  gross AS gross_gbp, penalty AS penalty_gbp, CAST(gross - penalty AS DECIMAL(38,12)) AS net_gbp, CAST(CASE WHEN c = 0 THEN 0 WHEN c IS NOT NULL AND d IS NOT NULL THEN least(d, c) END AS DECIMAL(20,6)) AS sla_numerator_mwh,
  CAST(CASE WHEN c = 0 THEN 0 WHEN c IS NOT NULL AND cap IS NOT NULL THEN least(cap, c) END AS DECIMAL(20,6)) AS availability_numerator_mwh,
  CASE WHEN commitment_status = 'no_commitment' THEN 'not_applicable' WHEN commitment_status = 'missing' OR d IS NULL THEN 'provisional' ELSE 'final' END AS sla_status,
  CASE WHEN commitment_status = 'no_commitment' THEN 'not_applicable' WHEN commitment_status = 'missing' OR cap IS NULL THEN 'provisional' ELSE 'final' END AS availability_status,
  CASE WHEN commitment_status = 'missing' OR d IS NULL OR NOT contract OR extra IS NULL THEN 'provisional' ELSE 'final' END AS financial_status,
  coalesce(c IS NOT NULL AND n > 1, false) AS corrected, c AS committed_mwh, d AS delivered_mwh, cap AS capacity_mwh FROM z)"""
FACTS = ["l_orderkey", "l_linenumber", "commitment_status", "shortfall_mwh", "excess_mwh", "billable_mwh", "unbilled_mwh", "gross_gbp", "penalty_gbp", "net_gbp", "sla_numerator_mwh", "availability_numerator_mwh", "sla_status", "availability_status", "financial_status", "corrected"]


def kernel_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_results(_kernel_inputs(spark, sf_dir))


@query(KERNEL + f" SELECT {', '.join(FACTS)} FROM facts")
def q11_interval_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_facts(spark, sf_dir).select(*FACTS)


@query(KERNEL + """, s AS (SELECT l_suppkey, count(*) AS expected, count(committed_mwh) AS commitments, count(*) FILTER (WHERE committed_mwh > 0) AS applicable, count(*) FILTER (WHERE committed_mwh > 0 AND delivered_mwh IS NOT NULL) AS accepted,
  count(*) FILTER (WHERE committed_mwh > 0 AND capacity_mwh IS NOT NULL) AS final_capacity, sum(committed_mwh) AS committed, sum(sla_numerator_mwh) AS sla_n, sum(net_gbp) AS net, count(*) FILTER (WHERE financial_status <> 'final') AS open_financial FROM facts WHERE l_linenumber <> 7 AND (l_suppkey % 5 <> 0 OR delivered_mwh IS NOT NULL) AND l_linenumber NOT IN (2, 5, 6) GROUP BY l_suppkey)
SELECT l_suppkey, expected, applicable, accepted, CASE WHEN applicable = 0 THEN 'not_applicable' WHEN accepted = applicable THEN 'final' ELSE 'provisional' END AS sla_status,
 CASE WHEN accepted = applicable AND committed <> 0 THEN CAST(round_even(100 * sla_n / committed, 6) AS DECIMAL(20,6)) END AS sla_percent, CASE WHEN accepted = applicable AND open_financial = 0 THEN net END AS net_gbp FROM s""".replace("round_even(100 * sla_n / committed, 6)", "round_even(CAST(100 * sla_n AS DOUBLE) / CAST(committed AS DOUBLE), 6)"))
def q12_summary_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.plans.product import summary

    n = F.col("l_linenumber")
    scoped = kernel_facts(spark, sf_dir).where((n != 7) & ((F.col("l_suppkey") % 5 != 0) | F.col("delivered_mwh").isNotNull()) & ~n.isin(2, 5, 6))
    got = summary(scoped, ["l_suppkey"])
    return got.select("l_suppkey", F.col("expected_count").alias("expected"), F.col("applicable_count").alias("applicable"), F.col("accepted_count").alias("accepted"), "sla_status", "sla_percent", "net_gbp")


@query(KERNEL.replace("l_suppkey, commitment_status", "l_suppkey, l_returnflag, commitment_status") + """, s AS (SELECT l_suppkey, l_linenumber, l_returnflag, count(*) AS expected, count(committed_mwh) = count(*) AS complete, count(*) FILTER (WHERE committed_mwh > 0) AS applicable, count(*) FILTER (WHERE committed_mwh > 0 AND delivered_mwh IS NOT NULL) AS accepted,
  sum(committed_mwh) AS committed, sum(sla_numerator_mwh) AS sla_n, sum(net_gbp) AS net, count(*) FILTER (WHERE financial_status <> 'final') AS open_financial FROM facts GROUP BY ALL)
SELECT l_suppkey, l_linenumber, l_returnflag, expected, applicable, accepted, CASE WHEN complete AND applicable = 0 THEN 'not_applicable' WHEN complete AND accepted = applicable THEN 'final' ELSE 'provisional' END AS sla_status,
 CASE WHEN complete AND accepted = applicable AND applicable > 0 THEN CAST(round_even(CAST(100 * sla_n AS DOUBLE) / CAST(committed AS DOUBLE), 6) AS DECIMAL(20,6)) END AS sla_percent, CASE WHEN complete AND accepted = applicable AND open_financial = 0 THEN net END AS net_gbp FROM s""")
def q12_whole_summary_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.plans.product import summary

    got = summary(kernel_facts(spark, sf_dir), ["l_suppkey", "l_linenumber", "l_returnflag"])
    return got.select("l_suppkey", "l_linenumber", "l_returnflag", F.col("expected_count").alias("expected"), F.col("applicable_count").alias("applicable"), F.col("accepted_count").alias("accepted"), "sla_status", "sla_percent", "net_gbp")


@query("SELECT l_orderkey, CASE WHEN count(*) = 1 THEN max(CAST(l_extendedprice AS DECIMAL(18,2))) END AS only_price FROM lineitem GROUP BY 1")
def q13_singleton_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(relations.only(F.col("l_extendedprice").cast("decimal(18,2)")).alias("only_price"))


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def q14_sorted_distinct_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(relations.sorted_set("l_returnflag").alias("flags"))


@query(KERNEL + """ SELECT count(*) FILTER (WHERE financial_status = 'final') AS final, count(*) FILTER (WHERE sla_status = 'provisional') AS provisional, count(*) FILTER (WHERE commitment_status = 'missing') AS missing,
 count(*) FILTER (WHERE corrected) AS corrected, count(*) FILTER (WHERE shortfall_mwh > 0) AS shortfall, count(*) FILTER (WHERE excess_mwh > 0) AS excess FROM facts""")
def q15_status_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.plans.product import status_filters

    return kernel_facts(spark, sf_dir).agg(*(F.count_if(rule).alias(name) for name, rule in status_filters().items()))


@query("""SELECT c_custkey, c_nationkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY' AND c_nationkey IS NOT NULL AND c_nationkey IN (3, 7, 11) AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'""")
def q16_tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.plans.product import scoped

    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    wanted = [F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"), F.col("o_orderstatus") == "F"]
    return scoped(rows, F.col("c_mktsegment") != "MACHINERY", "c_nationkey", [3, 7, 11], wanted).select("c_custkey", "c_nationkey", "o_orderkey")


@query("SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total_rows FROM orders WHERE o_orderstatus = 'O' ORDER BY price DESC, o_orderkey LIMIT 50 OFFSET 100")
def q17_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return relations.page(rows, [F.desc("price"), F.asc("o_orderkey")], number=3, size=50)


@query("SELECT event_id, user_id, ts, (SELECT count(*) FROM events) > 200 AS truncated FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def q18_history_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return relations.newest(rows, 200, [F.desc("ts"), F.desc("event_id")])


@query("""WITH m AS (SELECT DISTINCT o_orderpriority AS version_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT o_orderpriority AS version_id, max(o_orderdate) AS published_at FROM orders GROUP BY 1)
SELECT version_id, published_at FROM p JOIN m USING (version_id) ORDER BY published_at DESC, version_id DESC LIMIT 1""")
def q19_latest_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.plans.serving import latest_ready

    orders = read(spark, sf_dir, "orders")
    markers = orders.select(F.col("o_orderpriority").alias("version_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("started").alias("status"))
    published = orders.groupBy(F.col("o_orderpriority").alias("version_id")).agg(F.max("o_orderdate").alias("published_at"))
    return latest_ready(published, markers)


NEXT_ORDERS = "SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    key = F.col("o_orderkey")
    following = base.select(F.when(key % 11 == 0, key + 100000000).otherwise(key).alias("o_orderkey"), "o_custkey", F.when(key % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderdate")
    return base, following


@query(f"""WITH n AS ({NEXT_ORDERS}) SELECT coalesce(b.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete'
 WHEN b.o_custkey IS NOT DISTINCT FROM n.o_custkey AND b.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus AND b.o_orderdate IS NOT DISTINCT FROM n.o_orderdate THEN 'unchanged' ELSE 'update' END AS change FROM orders b FULL JOIN n ON b.o_orderkey = n.o_orderkey""")
def q20_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.compared(*_versions(spark, sf_dir), ["o_orderkey"])


@query(NEXT_ORDERS)
def q21_snapshot_clone_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, following = _versions(spark, sf_dir)
    return relations.applied(base, following, relations.compared(base, following, ["o_orderkey"]), ["o_orderkey"])


@query("""WITH v AS (SELECT o_custkey % 9 AS version_id, max(o_orderdate) AS published_at FROM orders GROUP BY 1)
SELECT version_id, published_at, CASE WHEN row_number() OVER (ORDER BY published_at DESC, version_id DESC) <= 2 THEN 'keep' WHEN version_id = 4 THEN 'protected' ELSE 'delete' END AS action FROM v""")
def q22_retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.plans.serving import retention_plan

    versions = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 9).alias("version_id")).agg(F.max("o_orderdate").alias("published_at"))
    return retention_plan(versions, keep=2, protected=[4])


@query("""SELECT count(*) AS row_count, count(DISTINCT o_orderkey) AS key_count, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date,
 CAST(sum(CAST(('0x' || substr(sha256(coalesce(CAST(o_custkey AS VARCHAR), '<null>') || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '|' || CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus), 1, 12)) AS BIGINT)) AS VARCHAR) AS content_sum FROM orders""")
def q23_dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.profile(_versions(spark, sf_dir)[0], ["o_orderkey"], "o_orderdate")


PERIODS = "SELECT o_custkey, o_orderkey, o_orderdate AS a, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS b FROM orders"


@query(f"WITH p AS ({PERIODS}), q AS (SELECT *, coalesce(b, TIMESTAMP '9999-12-31') AS z FROM p) SELECT x.o_custkey, x.o_orderkey AS left_o_orderkey, y.o_orderkey AS right_o_orderkey FROM q x JOIN q y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a < y.z AND y.a < x.z")
def q24_overlap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.when(F.col("o_orderkey") % 5 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))
    periods = order_versions(spark, sf_dir).withColumn("effective_to_utc", F.col("effective_to_utc") + later)
    return ranges.overlapping_pairs(periods, ["o_custkey"], "effective_from_utc", "effective_to_utc", "o_orderkey")


@query("SELECT o_orderkey, 'customer_reference_missing' AS code FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 <> 0)")
def q25_referential_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = read(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(parents, "o_custkey", "left_anti").select("o_orderkey", F.lit("customer_reference_missing").alias("code"))


@query(f"""WITH p AS ({PERIODS}), q AS (SELECT o.o_orderkey AS k, o.o_custkey, o.o_orderdate + INTERVAL 12 HOUR AS t FROM orders o)
SELECT k AS o_orderkey, CASE count(p.o_orderkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS coverage FROM q LEFT JOIN p ON p.o_custkey = q.o_custkey AND p.o_orderkey % 3 <> 0 AND p.a <= t AND (p.b IS NULL OR t < p.b) GROUP BY k""")
def q26_single_coverage_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.when(F.col("o_orderkey") % 5 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))
    versions = order_versions(spark, sf_dir).withColumn("effective_to_utc", F.col("effective_to_utc") + later).where("o_orderkey % 3 <> 0").drop("o_orderkey", "o_orderpriority")
    asked = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") + F.expr("interval 12 hours")).alias("t"))
    return ranges.coverage(asked, "o_orderkey", versions, ["o_custkey"], "effective_from_utc", "effective_to_utc", "t")


@query(f"""WITH l AS ({REVISION_LOG}) SELECT event_id, CASE WHEN min(value) OVER w <> max(value) OVER w THEN 'conflict' WHEN row_number() OVER (PARTITION BY user_id, event_type, rev ORDER BY event_id) = 1 THEN 'accepted' ELSE 'replay' END AS duplicate_class FROM l WINDOW w AS (PARTITION BY user_id, event_type, rev)""")
def q27_duplicate_revision_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.resolved_duplicates(revision_log(spark, sf_dir), [*IDENTITY, "rev"], "value", "event_id").select("event_id", "duplicate_class")


@query(f"SELECT value AS opaque_id FROM ({REVISION_LOG}) GROUP BY 1 HAVING min(user_id) <> max(user_id)")
def q28_opaque_id_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.contrary(revision_log(spark, sf_dir).withColumnRenamed("value", "opaque_id"), ["opaque_id"], "user_id")


@query("""WITH i AS (SELECT unnest([CASE WHEN l_quantity > 45 THEN 'quantity_too_large' END, CASE WHEN l_discount > 0.08 THEN 'discount_out_of_range' END, CASE WHEN l_tax = 0 THEN 'tax_missing' END]) AS code FROM lineitem) SELECT code, count(*) AS rows FROM i WHERE code IS NOT NULL GROUP BY 1""")
def q29_reason_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"quantity_too_large": F.col("l_quantity") > 45, "discount_out_of_range": F.col("l_discount") > 0.08, "tax_missing": F.col("l_tax") == 0}
    return relations.reason_counts(read(spark, sf_dir, "lineitem").withColumn("issues", relations.any_of(rules)), "issues")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 9 = 0 THEN 'conflict' ELSE 'replay' END AS load_class FROM orders")
def q30_idempotent_load_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_custkey", "o_orderstatus"), 256).alias("payload"))
    stored = rows.where("o_orderkey % 4 <> 0").withColumn("payload", F.when(F.col("o_orderkey") % 9 == 0, "other").otherwise(F.col("payload")))
    return relations.load_classes(rows, stored, "o_orderkey", "payload").select("o_orderkey", "load_class")


@query("SELECT event_id, sha256(length(CAST(user_id AS VARCHAR)) || ':' || user_id || '|' || length(event_type) || ':' || event_type || '|' || length(CAST(event_id AS VARCHAR)) || ':' || event_id) AS surrogate FROM events")
def q31_surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", surrogate_key("user_id", "event_type", "event_id").alias("surrogate"))


@query("""SELECT DISTINCT d AS local_date, CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, CAST(isodow(d) AS INTEGER) AS iso_weekday, dayname(d) AS weekday_name, CAST(date_trunc('week', d) AS DATE) AS week_start,
 CAST(date_diff('minute', timezone('Europe/London', CAST(d AS TIMESTAMP)), timezone('Europe/London', CAST(d + 1 AS TIMESTAMP))) / 30 AS INTEGER) AS half_hours FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def q32_dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.plans.mart import dim_date

    return dim_date(read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("local_date"))).select("local_date", "date_key", "year", "quarter", "month", "month_name", "iso_weekday", "weekday_name", "week_start", "half_hours")


@query(KERNEL + " SELECT DISTINCT sha256(length(commitment_status) || ':' || commitment_status || '|' || length(sla_status) || ':' || sla_status || '|' || length(availability_status) || ':' || availability_status || '|' || length(financial_status) || ':' || financial_status) AS data_status_key, commitment_status, sla_status, availability_status, financial_status FROM facts")
def q33_junk_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.plans.mart import dim_data_status

    return dim_data_status(kernel_facts(spark, sf_dir), ["commitment_status", "sla_status", "availability_status", "financial_status"])


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS lines, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def q34_star_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "c_mktsegment")
    return (
        t("lineitem").join(owners, F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"))
    )


@query("SELECT o_custkey, arg_max(o_orderpriority, {'d': o_orderdate, 'k': o_orderkey}) AS latest_priority FROM orders GROUP BY 1")
def q35_max_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("latest_priority"))


@query("""WITH n AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS t, sum(CAST(value AS DECIMAL(18,6))) AS total FROM events GROUP BY ALL),
g AS (SELECT event_type, unnest(generate_series(min(t), max(t), INTERVAL 30 MINUTE)) AS t FROM n GROUP BY 1) SELECT event_type, t, total FROM g LEFT JOIN n USING (event_type, t)""")
def q36_gap_fill_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.date_trunc("hour", "ts") + F.make_dt_interval(mins=(F.minute("ts").cast("int") / 30).cast("int") * 30)
    sums = read(spark, sf_dir, "events").groupBy("event_type", slot.alias("t")).agg(F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))
    return spine.gap_filled(sums, ["event_type"], "t")


@query(KERNEL + " SELECT l_orderkey, l_linenumber, delivered_mwh IS DISTINCT FROM capacity_mwh AS differs FROM facts")
def q37_null_safe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_facts(spark, sf_dir).select("l_orderkey", "l_linenumber", relations.differs(F.col("delivered_mwh"), F.col("capacity_mwh")).alias("differs"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber % 4 WHEN 0 THEN q WHEN 1 THEN q / 1000 WHEN 2 THEN q / 3.6 END AS DECIMAL(20,6)) AS mwh FROM (SELECT *, CAST(l_quantity AS DECIMAL(18,6)) AS q FROM lineitem)""")
def q38_unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    unit = F.when(k == 0, "MWh_th").when(k == 1, "kWh_th").when(k == 2, "GJ_th").otherwise("t")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", to_mwh(F.col("l_quantity"), unit).alias("mwh"))


@query(f"""WITH d AS (SELECT CASE WHEN min(value) OVER w <> max(value) OVER w THEN 'conflict' WHEN row_number() OVER (PARTITION BY user_id, event_type, rev ORDER BY event_id) = 1 THEN 'accepted' ELSE 'replay' END AS c FROM ({REVISION_LOG}) WINDOW w AS (PARTITION BY user_id, event_type, rev))
SELECT count(*) AS raw, count(*) FILTER (WHERE c = 'accepted') AS accepted, count(*) FILTER (WHERE c = 'conflict') AS quarantined, count(*) FILTER (WHERE c = 'replay') AS duplicates, true AS reconciled FROM d""")
def q39_reconciliation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.plans.load import reconciliation

    classes = relations.resolved_duplicates(revision_log(spark, sf_dir), [*IDENTITY, "rev"], "value", "event_id")
    return reconciliation(classes.withColumn("outcome", F.replace("duplicate_class", F.lit("conflict"), F.lit("quarantined"))))


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL")
def q40_stream_30m_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calorant.streaming.windows import counted_windows, drained

    source = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    counts = counted_windows(source.select("ts", "event_type"), "ts", ["event_type"], "30 minutes")
    return drained(counts, shared_folder(spark, "stream"), ["window_start", "event_type"])


