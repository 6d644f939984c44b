"""A generated world of revisioned feeds: deterministic, of any size, made by Spark.

Point k has customer, site, delivery point, meter and contract of number k. Quantities vary by a hash
of the seed, the point and the interval's index. Point 1 holds the scenarios of its first local day:
shortfall, excess, no commitment, a missing commitment, a corrected boundary, a commitment changed
after the fact, and capacities that are corrected, provisional, zero and missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorant.functions.calendar import day_bounds
from calorant.functions.keys import state_fingerprint, surrogate_key
from calorant.operators.spine import half_hour_grid, local_days

SYSTEM, SEED = "generated", 20260828
MWH = "decimal(20,6)"
#: Deliveries of point 1 on its first day, by half hour from 1.
DELIVERED = {3: "4.7", 4: "5.6", 5: "5.1", 6: "0", 7: "4.9", 9: "4.9", 10: "5.1", 11: "5.2"}


def _name(prefix: str) -> Column:
    return F.format_string(f"{prefix}-%03d", "point")


def _at(text: str | Column) -> Column:
    return (F.lit(text) if isinstance(text, str) else text).cast("timestamp_ntz")


def _feed(df: DataFrame, identity: list[str], payload: list[str]) -> DataFrame:
    """Adds source system and lineage hashes, approval at publication."""
    df = df.withColumn("source_system_id", F.lit(SYSTEM))
    if "approval_state" not in df.columns:
        df = df.withColumn("approval_state", F.lit("approved"))
    df = df.withColumn("approved_at_utc", F.when(F.col("approval_state") == "approved", F.col("published_at_utc")))
    return df.withColumns({"pipeline_identity_sha256": surrogate_key("source_system_id", *identity, "source_revision"), "pipeline_payload_sha256": state_fingerprint(*identity, "source_revision", *payload)})


def _revised(rows: DataFrame, changes: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """rows as revision 1, and for each change the rows that it holds for as a further revision."""
    rows = rows.withColumn("source_revision", F.lit(1).cast("long"))
    more = [rows.where(which).withColumns({k: v for k, v in new.items()}) for which, new in changes]
    return reduce(DataFrame.unionByName, more, rows)


def feeds(spark: SparkSession, start: str, days: int, points: int = 2, seed: int = SEED) -> dict[str, DataFrame]:
    """The nine feeds by name, for `days` London days from `start` (yyyy-mm-dd)."""
    who = spark.range(1, points + 1).select(F.col("id").alias("point")).withColumns({
        "customer_natural_id": _name("CUST"), "site_natural_id": _name("SITE"), "delivery_point_natural_id": _name("DP"), "meter_natural_id": _name("RM"), "register_natural_id": F.lit("ENERGY-01"),
        "contract_natural_id": _name("CONTRACT"), "usual": F.when(F.col("point") % 2 == 1, 5).otherwise(4).cast(MWH), "nameplate": F.when(F.col("point") % 2 == 1, 7).otherwise(6).cast(MWH), "most": F.when(F.col("point") % 2 == 1, 8).otherwise(7).cast(MWH),
    })
    since, early = _at("2020-01-01"), _at("2026-01-01")
    base = who.withColumns({"effective_from_utc": since, "effective_to_utc": _at(F.lit(None)), "published_at_utc": early})
    rename = (F.col("point") <= 2, {"source_revision": F.lit(2).cast("long"), "published_at_utc": early + F.expr("interval 30 days"), "display_name": F.concat("display_name", F.lit(" Ltd"))})
    customers = _revised(base.withColumns({"customer_version_id": _name("CV"), "display_name": _name("Customer"), "tenant_authorization_scope_id": _name("TENANT"), "version_record_status": F.lit("active")}), [rename])
    sites = _revised(base.withColumns({"site_version_id": _name("SV"), "site_name": _name("Site"), "iana_timezone": F.lit("Europe/London"), "version_record_status": F.lit("active")}), [])
    assignments = _revised(base.withColumns({"delivery_point_assignment_id": _name("DPA"), "delivery_point_name": _name("Point"), "assignment_status": F.lit("active")}), [])
    meters = _revised(base.withColumns({"meter_assignment_id": _name("MA"), "assignment_role": F.lit("authoritative_revenue"), "register_type": F.lit("thermal_energy"), "native_unit": F.lit("MWh_th"), "maximum_plausible_30_min_change": F.col("most"), "assignment_status": F.lit("active")}), [])
    rate = lambda x: F.lit(x).cast("decimal(18,6)")
    contracts = _revised(
        base.withColumns({"contract_terms_version_id": _name("CT"), "energy_rate_gbp_per_mwh_th": rate("49.5"), "sla_penalty_rate_gbp_per_mwh_th": rate("100"), "currency_code": F.lit("GBP"), "terms_status": F.lit("active")}),
        [(F.lit(True), {"source_revision": F.lit(2).cast("long"), "published_at_utc": early + F.expr("interval 60 days"), "energy_rate_gbp_per_mwh_th": rate("50")})],
    )
    span = spark.range(1).select(F.to_date(F.lit(start)).alias("start_date_local_inclusive"), F.date_add(F.to_date(F.lit(start)), days - 1).alias("end_date_local_inclusive"))
    grid = half_hour_grid(local_days(span)).select("operating_date", "interval_number", "interval_start_utc", "interval_end_utc")
    first = (F.col("point") == 1) & (F.col("operating_date") == F.to_date(F.lit(start)))
    n, begin = F.col("interval_number"), F.col("interval_start_utc")
    cell = who.join(grid).withColumn("jitter", F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "delivery_point_natural_id", F.unix_micros(F.to_timestamp_ltz(F.date_format("interval_start_utc", "yyyy-MM-dd HH:mm:ss")))), 256), 1, 8), 16, 10).cast("long") % 5)
    before = begin - F.expr("interval 12 hours")
    obligation = cell.where(~(first & (n == 7))).withColumns({
        "source_commitment_revision_id": F.concat_ws("/", "delivery_point_natural_id", begin.cast("string")), "published_at_utc": before, "schedule_record_status": F.lit("active"),
        "obligation_status": F.when(first & (n == 6), "no_commitment").otherwise("committed"), "committed_mwh_th": F.when(first & (n == 6), F.lit(0)).otherwise(F.col("usual")).cast(MWH),
    })
    commitments = _revised(obligation, [(first & (n == 11), {"source_revision": F.lit(2).cast("long"), "published_at_utc": begin + F.expr("interval 390 minutes"), "committed_mwh_th": F.lit("5.5").cast(MWH)})])
    orders = cell.where(first & n.isin(4, 10)).withColumns({
        "excess_order_natural_id": F.concat_ws("/", F.lit("EO"), "delivery_point_natural_id", n.cast("string")), "order_interval_line_id": F.concat_ws("/", F.lit("EOL"), "delivery_point_natural_id", n.cast("string")),
        "approved_extra_mwh_th": F.when(n == 4, "0.4").otherwise("0.0").cast(MWH), "order_state": F.when(n == 4, "approved").otherwise("cancelled"), "published_at_utc": before,
    }).withColumn("source_revision", F.lit(1).cast("long"))
    quantity = F.col("usual") + (F.col("jitter") / F.lit(100).cast("decimal(3,0)")).cast(MWH)
    for k, v in DELIVERED.items():
        quantity = F.when(first & (n == k), F.lit(v).cast(MWH)).otherwise(quantity)
    w = Window.partitionBy("point").orderBy("interval_start_utc").rowsBetween(Window.unboundedPreceding, 0)
    ends = cell.select("point", "meter_natural_id", "register_natural_id", "operating_date", "interval_number", "interval_start_utc", F.col("interval_end_utc").alias("reading_at_utc"), (F.lit(1000).cast(MWH) + F.sum(quantity.cast(MWH)).over(w)).cast(MWH).alias("cumulative_value"))
    zero = who.join(span.select(day_bounds(F.col("start_date_local_inclusive"))[0].alias("reading_at_utc"))).select("point", "meter_natural_id", "register_natural_id", F.lit(None).cast("date").alias("operating_date"), F.lit(0).alias("interval_number"), F.col("reading_at_utc").alias("interval_start_utc"), "reading_at_utc", F.lit(1000).cast(MWH).alias("cumulative_value"))
    corrected = (F.col("point") == 1) & (F.col("operating_date") == F.to_date(F.lit(start))) & (F.col("interval_number") == 9)
    reading = ends.unionByName(zero).withColumns({"register_type": F.lit("thermal_energy"), "native_unit": F.lit("MWh_th"), "reading_method": F.lit("actual"), "reading_status": F.lit("active"), "published_at_utc": F.col("reading_at_utc") + F.expr("interval 20 minutes"), "source_reading_revision_id": F.concat_ws("/", "meter_natural_id", F.col("reading_at_utc").cast("string"))})
    readings = _revised(
        reading.withColumn("cumulative_value", F.when(corrected, F.col("cumulative_value") - F.lit("0.2").cast("decimal(2,1)")).otherwise(F.col("cumulative_value")).cast(MWH)),
        [(corrected, {"source_revision": F.lit(2).cast("long"), "published_at_utc": F.col("reading_at_utc") + F.expr("interval 30 hours"), "cumulative_value": (F.col("cumulative_value") + F.lit("0.2").cast("decimal(2,1)")).cast(MWH)})],
    )
    ceiling = F.col("nameplate") - F.lit("0.5").cast("decimal(2,1)")
    assessed = cell.where(~(first & (n == 16))).withColumns({
        "source_capacity_revision_id": F.concat_ws("/", F.lit("CAP"), "delivery_point_natural_id", begin.cast("string")), "published_at_utc": begin,
        "assessment_status": F.when(first & n.isin(13, 14), "provisional").otherwise("final"), "deliverable_capacity_mwh_th": F.when(first & (n == 15), F.lit(0)).when(first & (n == 13), F.lit(6)).otherwise(ceiling).cast(MWH),
    })
    capacity = _revised(assessed, [
        (first & (n == 13), {"source_revision": F.lit(2).cast("long"), "published_at_utc": begin + F.expr("interval 210 minutes"), "assessment_status": F.lit("final"), "deliverable_capacity_mwh_th": F.lit("5.5").cast(MWH)}),
        (first & (n == 13), {"source_revision": F.lit(3).cast("long"), "published_at_utc": begin + F.expr("interval 1530 minutes"), "assessment_status": F.lit("final"), "deliverable_capacity_mwh_th": F.lit("4.5").cast(MWH)}),
    ])
    interval = ["delivery_point_natural_id", "interval_start_utc"]
    return {
        "customer_master": _feed(customers, ["customer_version_id"], ["display_name", "version_record_status"]), "industrial_site_master": _feed(sites, ["site_version_id"], ["site_name"]),
        "delivery_point_assignment": _feed(assignments, ["delivery_point_assignment_id"], ["assignment_status"]), "revenue_meter_assignment": _feed(meters, ["meter_assignment_id"], ["assignment_status"]),
        "contract_terms": _feed(contracts, ["contract_terms_version_id"], ["energy_rate_gbp_per_mwh_th", "terms_status"]), "commitment_schedule": _feed(commitments, interval, ["committed_mwh_th", "schedule_record_status"]),
        "approved_excess_order": _feed(orders, ["order_interval_line_id"], ["approved_extra_mwh_th", "order_state"]),
        "revenue_meter_reading": _feed(readings, ["meter_natural_id", "register_natural_id", "reading_at_utc"], ["cumulative_value", "reading_status"]),
        "delivery_point_capacity_assessment": _feed(capacity, interval, ["deliverable_capacity_mwh_th", "assessment_status"]),
    }


def run_coverage(spark: SparkSession, start: str, days: int, runs: int = 1) -> DataFrame:
    """Control rows of successful runs over the same days."""
    return spark.range(runs).select(
        F.concat(F.lit("batch-"), F.col("id").cast("string")).alias("pipeline_run_id"), F.to_date(F.lit(start)).alias("start_date_local_inclusive"), F.date_add(F.to_date(F.lit(start)), days - 1).alias("end_date_local_inclusive"),
        F.lit("succeeded").alias("reconciliation_status"), (_at("2026-09-01") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("generated_at_utc"),
    )
