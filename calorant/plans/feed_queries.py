"""Queries of feeds as text, of hot keys and of deep pages on the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorant.functions.keys import state_fingerprint
from calorant.operators import digests, ranges, relations, scans, temporal
from calorant.operators.conformance import conformance
from calorant.plans.analogues import read, revision_log
from calorant.plans.driver_queries import HISTORY
from calorant.plans.folders import settled, shared_folder
from calorant.plans.load import IDENTITY, PAYLOAD, load
from calorant.plans.registry import query
from calorant.sources import jsonlines

#: Parts that a hot group is split into.
PARTS = 16


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE sha256(concat('{', CASE o_orderkey % 4 WHEN 1 THEN concat('"a\\"b":"', o_orderpriority, '\\n",') WHEN 2 THEN concat('"c":{"x":[1,{"m":null,"z":true}],"y":', o_custkey, '.0},') ELSE '' END,
 '"key":', o_orderkey, ',"price":', o_totalprice, ',"status":"', o_orderstatus, '"}')) END AS payload_sha256, CASE o_orderkey % 4 WHEN 3 THEN 'duplicate_json_key' END AS issue FROM orders""")
def q52_canonical_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of every order, its keys out of order: plain, with escapes, nested, or with a key twice at depth."""
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    key, price, kind = F.col("o_orderkey"), F.col("o_totalprice").cast("string"), F.col("o_orderkey") % 4
    kinds = [text(""), text('"a\\"b":"', F.col("o_orderpriority"), '\\n" , '), text('"c": {"y":', F.col("o_custkey").cast("string"), '.00,"x":[1, {"z":true,"m":null}]},'), text('"d":{"e":1,"e":2},')]
    own = F.when(kind == 1, kinds[1]).when(kind == 2, kinds[2]).when(kind == 3, kinds[3]).otherwise(kinds[0])
    line = text('{ "status" : "', F.col("o_orderstatus"), '",', own, '"price":', price, F.when(F.contains(price, F.lit("E")), "").otherwise("00"), ',\t"key":', key.cast("string"), "}")
    rows = jsonlines.objects(read(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")))
    return rows.select("o_orderkey", F.sha2("payload", 256).alias("payload_sha256"), "issue")


@query("SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS line_number FROM orders")
def q53_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a text file for each priority, in order of their keys, and read back with each line's number."""
    path = shared_folder(spark, "lines")
    line = F.concat_ws("|", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("line")
    orders = read(spark, sf_dir, "orders").repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey")
    orders.select("o_orderpriority", line).write.partitionBy("o_orderpriority").text(path)
    rows = jsonlines.numbered(spark, f"{path}/*/*.txt")
    return rows.select(F.substring_index("line", "|", 1).alias("o_orderpriority"), F.substring_index("line", "|", -1).cast("long").alias("o_orderkey"), "line_number")


@query("""SELECT event_id, max(value) OVER w1 AS most_before, count(*) FILTER (WHERE value > 50) OVER w2 AS large, lag(user_id) OVER w AS user_before, lead(ts) OVER w AS next_ts
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id), w1 AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def q54_hot_group_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running maximum and count, row before and after, in five groups of all events, each spread over many tasks."""
    columns = {"most_before": scans.max_before(F.col("value")), "large": scans.count_upto(F.col("value") > 50), "user_before": scans.previous(F.col("user_id")), "next_ts": scans.following(F.col("ts"))}
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id", "value")
    return scans.scanned(events, ["event_type"], ["ts", "event_id"], columns, PARTS).select("event_id", *columns)


HOT_VERSIONS = "SELECT o_orderstatus AS status, o_orderkey AS version, o_orderdate AS a, CASE WHEN o_orderkey % 50 = 0 THEN o_orderdate + INTERVAL 3 DAY ELSE o_orderdate + to_hours(1 + o_orderkey % 20) END AS b FROM orders"


@query(f"WITH v AS ({HOT_VERSIONS}), f AS (SELECT l_orderkey, l_linenumber, l_linestatus AS status, l_shipdate + to_hours(CAST(l_partkey % 48 AS INTEGER)) AS t FROM lineitem) SELECT l_orderkey, l_linenumber, version FROM f LEFT JOIN v ON v.status = f.status AND a <= t AND t < b")
def q55_in_force_on_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line at an instant with the orders of its status in force then: a few keys with thousands of overlapping versions each."""
    d, hours = F.col("o_orderdate").cast("timestamp_ntz"), lambda n: F.make_dt_interval(hours=n.cast("int"))
    end = F.when(F.col("o_orderkey") % 50 == 0, d + F.make_dt_interval(days=F.lit(3))).otherwise(d + hours(1 + F.col("o_orderkey") % 20))
    versions = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("version"), d.alias("a"), end.alias("b"))
    t = F.col("l_shipdate").cast("timestamp_ntz") + hours(F.col("l_partkey") % 48)
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("status"), t.alias("t"))
    return ranges.effective_join(lines, versions, ["status"], "a", "b", "t", hidden=("a", "b"), parts=PARTS).select("l_orderkey", "l_linenumber", "version")


@query("""WITH e AS (SELECT event_id, event_type, ts AS a, ts + INTERVAL 10 MINUTE AS b FROM events) SELECT x.event_id, count(y.event_id) AS overlaps FROM e x LEFT JOIN e y ON y.event_type = x.event_type AND y.event_id <> x.event_id AND x.a < y.b AND y.a < x.b GROUP BY x.event_id""")
def q56_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of its type each event's ten minutes overlap, without making pairs."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("a"))
    rows = rows.withColumn("b", F.col("a") + F.make_dt_interval(mins=F.lit(10)))
    return ranges.overlap_counts(rows, ["event_type"], "a", "b", "event_id", PARTS).select("event_id", "overlaps")


@query("SELECT c_custkey, count(event_id) AS events FROM customer LEFT JOIN events ON ts >= TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 700 AS INTEGER)) AND (c_custkey % 3 = 0 OR ts < TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 700 + c_custkey % 500 AS INTEGER))) GROUP BY 1")
def q57_long_and_open_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a range of time of each customer: hours, weeks, or open. Equal ranges are counted once."""
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("c_custkey") % 700).cast("int"))
    end = F.when(F.col("c_custkey") % 3 != 0, start + F.make_dt_interval(hours=(F.col("c_custkey") % 500).cast("int")))
    asked = read(spark, sf_dir, "customer").select("c_custkey", start.alias("a"), end.alias("b"))
    at = F.col("ts").cast("timestamp_ntz")
    minutes = settled(read(spark, sf_dir, "events").groupBy(at.alias("t")).agg(F.count("*").alias("n")), "instants")
    counts = ranges.containment_join(minutes, asked.select("a", "b").distinct(), "t", "a", "b").groupBy("a", "b").agg(F.sum("n").alias("events"))
    found = asked.join(counts.withColumnsRenamed({"a": "_a", "b": "_b"}), (F.col("a") == F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")), "left")
    return found.select("c_custkey", F.coalesce("events", F.lit(0)).alias("events"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, total_rows FROM (SELECT *, count(*) OVER () AS total_rows, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS n, count(*) OVER () * 7 // 1000 AS page FROM lineitem) WHERE n > (page - 1) * 100 AND n <= page * 100")
def q58_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a hundred lines at seven tenths of all, located by the counts of ranges."""
    lines = read(spark, sf_dir, "lineitem")
    order = [F.desc("l_extendedprice"), *(F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))]
    page = lines.count() * 7 // 1000
    return relations.page(lines, order, page, 100, most=100, parts=PARTS).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "total_rows")


@query("""WITH b AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 500 <> 7), f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 700 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 900 <> 5)
SELECT coalesce(b.o_orderkey, f.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'insert' WHEN f.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS change FROM b FULL JOIN f ON b.o_orderkey = f.o_orderkey WHERE b.o_orderkey IS NULL OR f.o_orderkey IS NULL OR b.o_totalprice <> f.o_totalprice""")
def q59_changes_by_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that differ between two published versions of the orders, found from the top of their trees of digests."""
    orders, key = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey")
    base = orders.where(key % 500 != 7)
    following = orders.where(key % 900 != 5).withColumn("o_totalprice", F.when(key % 700 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    paths = [shared_folder(spark, name) for name in ("base", "following")]
    for df, path in zip((base, following), paths):
        digests.publish(df, ["o_orderkey"], path)
    return digests.changes(spark, *paths, ["o_orderkey"])


DECLARED = {"l_quantity": (2, 0), "l_extendedprice": (6, 1), "l_discount": (3, 2), "l_tax": (2, 1), "l_comment": (5, 2), "l_partkey": (3, 0), "l_returnflag": (3, 1)}


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'decimal({p},{s})' AS declared_type, 'inexact' AS state, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE round(CAST({c} AS DECIMAL(18,6)), {s}) <> CAST({c} AS DECIMAL(18,6))) AS over_scale, count(*) FILTER (WHERE abs(round(CAST({c} AS DECIMAL(18,6)), {s})) >= {10 ** (p - s)}) AS over_precision FROM lineitem"
    if c not in ("l_comment", "l_returnflag") else f"SELECT '{c}', 'decimal({p},{s})', '{'missing' if c == 'l_comment' else 'not_numeric'}', NULL, NULL, NULL, NULL" for c, (p, s) in DECLARED.items()))
def q60_stored_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the order lines against declared decimals: how many values have too many digits after the point, or before."""
    return conformance(read(spark, sf_dir, "lineitem"), DECLARED).drop("stored_type")


@query("""WITH i AS (SELECT o_orderkey AS k, sha256(CAST(o_orderkey AS VARCHAR)) AS id FROM orders) SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN 'new' ELSE 'replay' END AS load_class, 1 AS stored FROM i""")
def q61_loaded_in_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the orders loaded into a store by folders of hashes, then all, then all again: each is stored once."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias(IDENTITY), F.sha2(F.concat_ws("|", "o_custkey", "o_orderstatus"), 256).alias(PAYLOAD))
    path = shared_folder(spark, "store")
    first = load(rows.where("o_orderkey % 3 <> 0"), path, digits=1)
    second, third = load(rows, path, digits=1), load(rows, path, digits=1)
    if second != {"inserted": third["reused"] - first["inserted"], "reused": first["inserted"]} or third["inserted"]:
        raise RuntimeError(f"loads don't add up: {first}, {second}, {third}")
    times = spark.read.parquet(path).groupBy("o_orderkey").agg(F.count("*").cast("int").alias("stored"))
    return times.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "new").otherwise("replay").alias("load_class"), "stored")


CROSS_FEED = """WITH n AS (SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM customer) AS customers),
c AS (SELECT c_custkey AS c FROM customer WHERE c_custkey % 10 <> 9 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 50 = 3),
p AS (SELECT p_partkey AS p, p_partkey % customers AS c, p_partkey % 11 = 7 AS siteless, (p_partkey % customers) % 10 = 9 AS unknown, (p_partkey % customers) % 50 = 3 AS overlapped FROM part, n),
q AS (SELECT *, NOT (siteless OR unknown OR overlapped) AS sound, NOT (siteless OR unknown OR overlapped OR p % 13 = 5) AS metered FROM p),
o AS (SELECT o_orderkey AS o, q.* FROM orders, n, q WHERE q.p = o_orderkey % parts),
codes AS (
 SELECT 'customer_master' AS feed, CASE WHEN c % 50 = 3 THEN ['customer_effective_overlap'] ELSE [] END AS codes FROM c
 UNION ALL SELECT 'industrial_site_master', [] FROM p WHERE NOT siteless
 UNION ALL SELECT 'delivery_point_assignment', list_filter([CASE WHEN unknown OR overlapped AND NOT siteless THEN 'customer_reference_missing' END, CASE WHEN siteless THEN 'site_reference_missing' END], lambda x: x IS NOT NULL) FROM p
 UNION ALL SELECT 'revenue_meter_assignment', CASE WHEN metered THEN [] ELSE ['delivery_point_reference_missing'] END FROM q
 UNION ALL SELECT 'contract_terms', list_filter([CASE WHEN NOT sound THEN 'delivery_point_reference_missing' END, CASE WHEN unknown OR overlapped AND NOT siteless THEN 'customer_reference_missing' END], lambda x: x IS NOT NULL) FROM q
 UNION ALL SELECT 'delivery_point_capacity_assessment', CASE WHEN sound THEN [] ELSE ['delivery_point_assignment_coverage_missing'] END FROM o
 UNION ALL SELECT 'revenue_meter_reading', CASE WHEN NOT metered THEN ['meter_assignment_coverage_missing'] WHEN o % 17 = 1 THEN ['meter_register_metadata_mismatch'] ELSE [] END FROM o),
each AS (SELECT feed, unnest(CASE WHEN len(codes) = 0 THEN [NULL] ELSE codes END) AS code FROM codes)
SELECT feed, CASE WHEN code IS NULL THEN 'accepted' ELSE 'quarantined' END AS outcome, code, count(*) AS rows FROM each GROUP BY ALL"""


@query(CROSS_FEED)
def q62_cross_feed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven feeds made of customers, parts and orders, through all passes: references, overlaps and coverage across feeds, counted by code.

    Keys, not lines, are dealt out over all cores.
    """
    from calorant.plans import validation

    tasks = 3 * spark.sparkContext.defaultParallelism
    parts, customers, orders = (read(spark, sf_dir, t).select(k).repartition(tasks, k) for t, k in (("part", "p_partkey"), ("customer", "c_custkey"), ("orders", "o_orderkey")))
    n_parts, n_customers = max(1, parts.count()), max(1, customers.count())
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    stamp = {"source_schema_version": "1.0.0", "source_system_id": "s", "synthetic_data": True, "source_revision": 1, "revision_type": "original", "published_at_utc": "2026-08-01T00:00:00Z", "approval_state": "approved", "approved_at_utc": "2026-08-01T00:00:00Z", "approved_by": "ops"}
    period = {"effective_from_utc": "2020-01-01T00:00:00Z", "effective_to_utc": None}

    def lines(df: DataFrame, feed: str, key: str, **fields) -> DataFrame:
        """Lines of JSON; texts that vary are of letters, digits and marks that need no escape."""
        texts, own = "", []
        for n, v in {"source_schema_id": feed, **stamp, **fields}.items():
            if hasattr(v, "alias"):
                own += [F.lit(f'{texts}{"," if texts or own else "{"}"{n}":"'), v]
                texts = '"'
            else:
                texts += f'{"," if texts or own else "{"}"{n}":{json.dumps(v)}'
        return df.select(F.lpad(F.col(key).cast("string"), 14, "0").alias("locator"), F.concat(*own, F.lit(texts + "}")).alias("line"))

    p, c = F.col("p_partkey"), F.col("p_partkey") % n_customers
    point, customer, site = text("P-", p), text("C-", c), text("S-", p)
    half_hour = lambda k: F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(30 * k).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    versions = customers.where("c_custkey % 10 <> 9").withColumn("v", F.explode(F.when(F.col("c_custkey") % 50 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("k", 2 * F.col("c_custkey") + F.col("v"))
    key = F.col("c_custkey")
    own, o = F.col("o_orderkey") % n_parts, F.col("o_orderkey")
    feeds = {
        "customer_master": lines(versions, "customer_master", "k", customer_natural_id=text("C-", key), customer_version_id=F.concat_ws("-", F.lit("CV"), key.cast("string"), F.col("v").cast("string")), legal_name="L", display_name="D", industry_sector_code="metals", country_code="GB", lifecycle_status="active", tenant_authorization_scope_id="T", version_record_status="active", **period),
        "industrial_site_master": lines(parts.where("p_partkey % 11 <> 7"), "industrial_site_master", "p_partkey", site_natural_id=site, site_version_id=text("SV-", p), site_name="S", locality="Leeds", postal_area="LS", country_code="GB", region_code="GB-ENG", iana_timezone="Europe/London", operational_status="operational", version_record_status="active", **period),
        "delivery_point_assignment": lines(parts, "delivery_point_assignment", "p_partkey", delivery_point_assignment_id=text("A-", p), delivery_point_natural_id=point, delivery_point_name="N", site_natural_id=site, customer_natural_id=customer, service_type="industrial_steam", assignment_status="active", **period),
        "revenue_meter_assignment": lines(parts, "revenue_meter_assignment", "p_partkey", meter_assignment_id=text("MA-", p), meter_natural_id=text("M-", p), register_natural_id="R", delivery_point_natural_id=F.when(p % 13 == 5, text("PX-", p)).otherwise(point), assignment_role="authoritative_revenue", register_type="thermal_energy", native_unit="MWh_th", calibration_id="CAL", maximum_plausible_30_min_change="8.000000", assignment_status="active", **period),
        "contract_terms": lines(parts, "contract_terms", "p_partkey", contract_natural_id=text("K-", p), contract_terms_version_id=text("KV-", p), delivery_point_natural_id=point, customer_natural_id=customer, energy_rate_gbp_per_mwh_th="50.000000", sla_penalty_rate_gbp_per_mwh_th="100.000000", currency_code="GBP", rate_unit="GBP/MWh_th", terms_status="active", **period),
        "revenue_meter_reading": lines(orders, "revenue_meter_reading", "o_orderkey", source_reading_revision_id=text("RR-", o), meter_natural_id=text("M-", own), register_natural_id="R", reading_at_utc=half_hour(o), register_type="thermal_energy", cumulative_value="1.000000", native_unit=F.when(o % 17 == 1, "kWh_th").otherwise("MWh_th"), reading_method="actual", reading_status="active"),
        "delivery_point_capacity_assessment": lines(orders, "delivery_point_capacity_assessment", "o_orderkey", source_capacity_revision_id=text("CAP-", o), delivery_point_natural_id=text("P-", own), interval_start_utc=half_hour(o), interval_end_utc=half_hour(o + 1), assessment_status="final", nameplate_ceiling_mwh_th="7.000000", operational_restriction_mwh_th="0.500000", deliverable_capacity_mwh_th="6.500000", quantity_unit="MWh_th", assessment_method="m", assessment_method_version="1", capacity_reason_code="normal", finalized_at_utc="2026-08-01T00:00:00Z"),
    }
    return validation.report(validation.outcomes(feeds))


@query(HISTORY + """, a AS (SELECT * FROM history WHERE event_type = 'click'), b AS (SELECT * FROM history WHERE event_type = 'purchase'),
points AS (SELECT user_id, known_from_utc AS t FROM a UNION SELECT user_id, known_from_utc FROM b),
said AS (SELECT p.user_id, t, a.rev AS click_rev, b.rev AS purchase_rev, b.value - a.value AS delta, CASE WHEN a.rev IS NULL OR b.rev IS NULL THEN 'provisional' WHEN b.value < a.value THEN 'short' ELSE 'final' END AS status
 FROM points p LEFT JOIN a ON a.user_id = p.user_id AND a.known_from_utc <= t AND (a.known_to_utc IS NULL OR t < a.known_to_utc) LEFT JOIN b ON b.user_id = p.user_id AND b.known_from_utc <= t AND (b.known_to_utc IS NULL OR t < b.known_to_utc)),
told AS (SELECT *, lag({'d': delta, 's': status}) OVER w AS before, row_number() OVER w AS n FROM said WINDOW w AS (PARTITION BY user_id ORDER BY t)),
kept AS (SELECT * FROM told WHERE n = 1 OR before.d IS DISTINCT FROM delta OR before.s <> status)
SELECT user_id, t AS known_from_utc, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS known_to_utc, click_rev, purchase_rev, CAST(delta AS DECIMAL(20,6)) AS delta, status FROM kept""")
def q63_history_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of two histories as known at each instant that either changed, one row a window of equal state."""
    logs = {kind: temporal.knowledge_history(revision_log(spark, sf_dir).where(F.col("event_type") == kind), ["user_id"], "rev", F.col("ts"), "event_id") for kind in ("click", "purchase")}
    history = {kind: settled(h.select("user_id", F.col("rev").alias(f"{kind}_rev"), F.col("value").alias(f"{kind}_value"), "known_from_utc", "known_to_utc"), kind) for kind, h in logs.items()}
    facts = temporal.change_points([h.select("user_id", F.col("known_from_utc").alias("t")) for h in history.values()])
    for h in history.values():
        facts = temporal.as_known_at(settled(facts, "facts"), h, ["user_id"], "t").drop("known_from_utc", "known_to_utc")
    delta = (F.col("purchase_value") - F.col("click_value")).cast("decimal(20,6)")
    missing = F.col("click_rev").isNull() | F.col("purchase_rev").isNull()
    facts = facts.withColumns({"delta": delta, "status": F.when(missing, "provisional").when(delta < 0, "short").otherwise("final")}).withColumn("state", state_fingerprint("delta", "status"))
    windows = temporal.coalesce_states(facts, ["user_id"], ["t"], "state")
    return windows.select("user_id", F.col("t").alias("known_from_utc"), "known_to_utc", "click_rev", "purchase_rev", "delta", "status")


@query("""SELECT meaning, rank, count(l_orderkey) AS lines FROM (VALUES ('A', 'accepted', 1), ('N', 'new', 2), ('R', 'returned', 3), ('X', 'unknown', NULL)) AS v(flag, meaning, rank) LEFT JOIN lineitem ON l_returnflag = flag GROUP BY ALL""")
def q64_named_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation of values, the names of flags, with the order lines of each."""
    names = spark.sql("SELECT * FROM VALUES ('A', 'accepted', 1), ('N', 'new', 2), ('R', 'returned', 3), ('X', 'unknown', NULL) AS v(flag, meaning, rank)")
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("lines"))
    return counts.join(F.broadcast(names), "flag", "right").select("meaning", "rank", F.coalesce("lines", F.lit(0)).alias("lines"))
