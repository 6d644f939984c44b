"""The mart: calendar and status dimensions, and the facts of the current and of the known state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorant.functions.calendar import ZONE, date_key, half_hours, local_time, offset_minutes
from calorant.functions.keys import readable_time, state_fingerprint, surrogate_key
from calorant.functions.measures import delivery_status, interval_results, to_mwh
from calorant.operators import ranges, relations, spine, temporal
from calorant.plans.folders import settled


def dim_date(days: DataFrame, zone: str = ZONE) -> DataFrame:
    """A row for each local_date: its key, calendar parts, and 46, 48 or 50 half hours."""
    d = F.col("local_date")
    return days.select("local_date").distinct().withColumns({
        "date_key": date_key(d), "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "month_name": F.date_format(d, "MMMM"), "day_of_month": F.day(d),
        "iso_weekday": F.weekday(d) + 1, "weekday_name": F.date_format(d, "EEEE"), "week_start": F.date_trunc("week", d).cast("date"), "half_hours": F.size(half_hours(d, zone)),
    })


def dim_interval(starts: DataFrame, zone: str = ZONE) -> DataFrame:
    """A row for each interval_start_utc: local clock, offset from UTC and whether summer time is on."""
    t = F.col("interval_start_utc")
    return starts.select("interval_start_utc").distinct().withColumns({
        "interval_end_utc": t + F.expr("interval 30 minutes"), "local_start": local_time(t, zone), "local_date_key": date_key(local_time(t, zone).cast("date")),
        "utc_offset_minutes": offset_minutes(t, zone), "is_dst": offset_minutes(t, zone) != 0,
    })


def dim_data_status(facts: DataFrame, statuses: list[str]) -> DataFrame:
    """Distinct combinations of statuses, with a key."""
    return facts.select(surrogate_key(*statuses).alias("data_status_key"), *statuses).distinct()


EPISODES = {
    "customer_master": ["customer_version_id"], "industrial_site_master": ["site_version_id"], "delivery_point_assignment": ["delivery_point_assignment_id"], "revenue_meter_assignment": ["meter_assignment_id"],
    "contract_terms": ["contract_terms_version_id"], "commitment_schedule": ["delivery_point_natural_id", "interval_start_utc"], "approved_excess_order": ["order_interval_line_id"],
    "revenue_meter_reading": ["meter_natural_id", "register_natural_id", "reading_at_utc"], "delivery_point_capacity_assessment": ["delivery_point_natural_id", "interval_start_utc"],
}
#: The measures and lineage that make a known state: a change in any opens a window.
STATE = [
    "delivery_point_assignment_id", "customer_version_id", "site_version_id", "contract_terms_version_id", "meter_assignment_id", "assignment_payload", "customer_payload", "site_payload", "contract_payload", "meter_payload",
    "commitment_payload", "order_payload", "opening_payload", "closing_payload", "capacity_payload", "committed_mwh", "delivered_mwh", "approved_extra_mwh", "capacity_mwh", "shortfall_mwh", "excess_mwh", "billable_mwh", "unbilled_mwh",
    "gross_gbp", "penalty_gbp", "net_gbp", "sla_numerator_mwh", "availability_numerator_mwh", "expected_count", "commitment_count", "applicable_count", "accepted_count", "final_capacity_count",
    "commitment_status", "delivery_status", "capacity_status", "contract_status", "access_status",
]


def _identity(feed: str) -> list[str]:
    return ["source_system_id", *EPISODES[feed]]


def _eligible(feed: str, df: DataFrame, history: bool) -> DataFrame:
    rows = df.where(temporal.eligible(history))
    return rows.where(temporal.before_start()) if feed == "approved_excess_order" else rows


def history_of(feed: str, df: DataFrame) -> DataFrame:
    """A feed's knowledge windows; capacities by the rule that final assessments outlast provisional ones."""
    clock = F.greatest("published_at_utc", "approved_at_utc")
    args = (_eligible(feed, df, True), _identity(feed), "source_revision", clock, "pipeline_identity_sha256")
    return temporal.capacity_history(*args, "assessment_status") if feed == "delivery_point_capacity_assessment" else temporal.knowledge_history(*args)


def current_of(feed: str, df: DataFrame) -> DataFrame:
    """A feed's present state: the latest approved revision, or for capacities the open window."""
    if feed == "delivery_point_capacity_assessment":
        return history_of(feed, df).where("known_to_utc is null")
    return temporal.latest_revision(_eligible(feed, df, False), _identity(feed), [F.desc("source_revision"), F.desc("pipeline_identity_sha256")])


def _parts(tables: dict[str, DataFrame], known: bool) -> dict[str, DataFrame]:
    """The columns of each feed that intervals take up, renamed so that they don't clash."""
    time = ["known_from_utc", "known_to_utc"] if known else []
    span = ["effective_from_utc", "effective_to_utc", *time]
    take = lambda feed, where, *cols: (tables[feed].where(where) if where else tables[feed]).select("source_system_id", *cols)
    mark = lambda name: (F.col("source_revision").alias(f"{name}_revision"), F.col("pipeline_payload_sha256").alias(f"{name}_payload"))
    reading = lambda end, at: tables["revenue_meter_reading"].where("register_type = 'thermal_energy'" if not known else "true").select(
        "source_system_id", "meter_natural_id", "register_natural_id", F.col("reading_at_utc").alias(at), F.col("source_reading_revision_id").alias(f"{end}_id"), F.col("reading_status").alias(f"{end}_status"), F.col("reading_method").alias(f"{end}_method"),
        F.col("native_unit").alias(f"{end}_unit"), F.col("cumulative_value").alias(f"{end}_value"), *mark(end), *time,
    )
    return {
        "assignment": take("delivery_point_assignment", "assignment_status = 'active'", "delivery_point_natural_id", "delivery_point_assignment_id", "customer_natural_id", "site_natural_id", *mark("assignment"), *span),
        "customer": take("customer_master", "version_record_status = 'active'", "customer_natural_id", "customer_version_id", "display_name", "tenant_authorization_scope_id", *mark("customer"), *span),
        "site": take("industrial_site_master", "version_record_status = 'active'", "site_natural_id", "site_version_id", *mark("site"), *span),
        "contract": take("contract_terms", "terms_status = 'active'", "delivery_point_natural_id", "customer_natural_id", "contract_terms_version_id", F.col("energy_rate_gbp_per_mwh_th").alias("energy_rate"), F.col("sla_penalty_rate_gbp_per_mwh_th").alias("penalty_rate"), *mark("contract"), *span),
        "meter": take("revenue_meter_assignment", "assignment_status = 'active' and assignment_role = 'authoritative_revenue'", "delivery_point_natural_id", "meter_assignment_id", "meter_natural_id", "register_natural_id", F.col("native_unit").alias("meter_unit"), "maximum_plausible_30_min_change", F.col("source_revision").alias("meter_assignment_revision"), F.col("pipeline_payload_sha256").alias("meter_payload"), *span),
        "opening": reading("opening", "interval_start_utc"), "closing": reading("closing", "interval_end_utc"),
        "commitment": take("commitment_schedule", None, "delivery_point_natural_id", "interval_start_utc", F.col("schedule_record_status").alias("schedule_status"), "obligation_status", F.when(F.col("schedule_record_status") == "active", F.col("committed_mwh_th")).alias("committed_mwh"), *mark("commitment"), *time),
        "capacity": take("delivery_point_capacity_assessment", None, "delivery_point_natural_id", "interval_start_utc", F.col("assessment_status").alias("capacity_status"), F.when(F.col("assessment_status") == "final", F.col("deliverable_capacity_mwh_th")).alias("capacity_mwh"), *mark("capacity"), *time),
        "order": take("approved_excess_order", None, "delivery_point_natural_id", "interval_start_utc", "order_interval_line_id", "order_state", F.col("approved_extra_mwh_th").alias("order_mwh"), *mark("order"), *time),
    }


def _one_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Orders by interval: their number, and state and quantity of an only one."""
    only = lambda c: relations.only(c).alias(c)
    return df.groupBy(*keys).agg(F.count("*").alias("order_count"), only("order_state"), only("order_mwh"), F.max("order_revision").alias("order_revision"), F.max("order_payload").alias("order_payload"))


def _measured(df: DataFrame) -> DataFrame:
    """Delivered energy by the register's ends, with its status."""
    end = lambda e: {k: F.col(f"{e}_{k}") for k in ("id", "status", "method", "unit", "value")}
    status = delivery_status(F.col("meter_assignment_id"), end("opening"), end("closing"), F.col("meter_unit"), F.col("maximum_plausible_30_min_change"))
    delta = F.col("closing_value") - F.col("opening_value")
    return df.withColumn("delivery_status", status).withColumn("delivered_mwh", F.when(F.col("delivery_status") == "accepted", to_mwh(delta, F.col("meter_unit"))))


INTERVAL = ["source_system_id", "delivery_point_natural_id", "interval_start_utc"]
REGISTER = ["source_system_id", "meter_natural_id", "register_natural_id"]


def current_facts(feeds: dict[str, DataFrame], coverage: DataFrame) -> DataFrame:
    """A row for each delivery point and covered half hour, by the present state of all feeds."""
    p = _parts({feed: current_of(feed, df) for feed, df in feeds.items()}, known=False)
    grid = spine.delivery_spine(coverage, p["assignment"]).drop("effective_from_utc", "effective_to_utc")
    for name, keys in (("customer", ["source_system_id", "customer_natural_id"]), ("site", ["source_system_id", "site_natural_id"]), ("contract", ["source_system_id", "delivery_point_natural_id", "customer_natural_id"]), ("meter", ["source_system_id", "delivery_point_natural_id"])):
        grid = ranges.effective_join(settled(grid, "grid"), p[name], keys, "effective_from_utc", "effective_to_utc", "interval_start_utc", "interval_end_utc").drop("effective_from_utc", "effective_to_utc")
    grid = grid.join(p["opening"], [*REGISTER, "interval_start_utc"], "left").join(p["closing"], [*REGISTER, "interval_end_utc"], "left")
    grid = grid.join(p["commitment"], INTERVAL, "left").join(p["capacity"], INTERVAL, "left").join(_one_order(p["order"], INTERVAL), INTERVAL, "left")
    return interval_results(_measured(grid))


def _points(feeds: dict[str, DataFrame], known: dict[str, DataFrame], grid: DataFrame) -> DataFrame:
    """(delivery_interval_key, known_from_utc): every instant at which an interval's inputs could change.

    Relationships come from all revisions, approved or not, so none is missed.
    """
    related = feeds["delivery_point_assignment"].select("source_system_id", "delivery_point_natural_id", "delivery_point_assignment_id", "customer_natural_id", "site_natural_id").distinct()
    metered = feeds["revenue_meter_assignment"].select("source_system_id", "delivery_point_natural_id", "meter_assignment_id", "meter_natural_id", "register_natural_id").distinct()
    bound = feeds["contract_terms"].select("source_system_id", "delivery_point_natural_id", "contract_terms_version_id").distinct()
    at = lambda feed, relation, keys: known[feed].select("source_system_id", *keys, "known_from_utc").join(relation, ["source_system_id", *keys]).select("source_system_id", "delivery_point_natural_id", "known_from_utc").distinct()
    whole = temporal.change_points([
        at("delivery_point_assignment", related.drop("customer_natural_id", "site_natural_id").distinct(), ["delivery_point_assignment_id"]),
        at("customer_master", related.select("source_system_id", "delivery_point_natural_id", "customer_natural_id").distinct(), ["customer_natural_id"]),
        at("industrial_site_master", related.select("source_system_id", "delivery_point_natural_id", "site_natural_id").distinct(), ["site_natural_id"]),
        at("revenue_meter_assignment", metered.select("source_system_id", "delivery_point_natural_id", "meter_assignment_id").distinct(), ["meter_assignment_id"]),
        at("contract_terms", bound, ["contract_terms_version_id"]),
    ])
    key = grid.select("delivery_interval_key", "source_system_id", "delivery_point_natural_id", "interval_start_utc", "interval_end_utc")
    one = [known[f].select(*INTERVAL, "known_from_utc").join(key, INTERVAL) for f in ("commitment_schedule", "approved_excess_order", "delivery_point_capacity_assessment")]
    read = known["revenue_meter_reading"].select(*REGISTER, "reading_at_utc", "known_from_utc").join(metered, REGISTER).select("source_system_id", "delivery_point_natural_id", "reading_at_utc", "known_from_utc")
    ends = [read.withColumnRenamed("reading_at_utc", side).join(key, ["source_system_id", "delivery_point_natural_id", side]) for side in ("interval_start_utc", "interval_end_utc")]
    every = [key.join(whole, ["source_system_id", "delivery_point_natural_id"]), *one, *ends]
    return temporal.change_points([x.select("delivery_interval_key", "known_from_utc") for x in every])


def history_facts(feeds: dict[str, DataFrame], coverage: DataFrame) -> DataFrame:
    """A row for each interval and window of knowledge in which its known state was one and the same.

    Histories, grid and change points are used several times each and are written once.
    """
    known = {feed: settled(history_of(feed, df), feed) for feed, df in feeds.items()}
    p = _parts(known, known=True)
    ever = p["assignment"].select("source_system_id", "delivery_point_natural_id", "effective_from_utc", "effective_to_utc").distinct()
    columns = ["delivery_interval_key", "source_system_id", "delivery_point_natural_id", "operating_date", "interval_number", "interval_start_utc", "interval_end_utc"]
    grid = settled(spine.delivery_spine(coverage, ever).select(*columns).distinct(), "grid")
    df = settled(_points(feeds, known, grid).withColumnRenamed("known_from_utc", "t").join(grid, "delivery_interval_key"), "points")
    for name, keys in (("assignment", ["source_system_id", "delivery_point_natural_id"]), ("customer", ["source_system_id", "customer_natural_id"]), ("site", ["source_system_id", "site_natural_id"]), ("contract", ["source_system_id", "delivery_point_natural_id", "customer_natural_id"]), ("meter", ["source_system_id", "delivery_point_natural_id"])):
        df = settled(temporal.bitemporal_join(df, p[name], keys, "interval_start_utc", "interval_end_utc", "t"), "points")
    for name, keys in (("opening", [*REGISTER, "interval_start_utc"]), ("closing", [*REGISTER, "interval_end_utc"]), ("commitment", INTERVAL), ("capacity", INTERVAL)):
        df = settled(temporal.as_known_at(df, p[name], keys, "t").drop("known_from_utc", "known_to_utc"), "points")
    orders = temporal.as_known_at(df.select("delivery_interval_key", "t", *INTERVAL), p["order"], INTERVAL, "t", "inner")
    df = df.join(_one_order(orders, ["delivery_interval_key", "t"]), ["delivery_interval_key", "t"], "left")
    states = interval_results(_measured(df)).withColumn("state_sha256", state_fingerprint(*STATE)).withColumnRenamed("t", "known_from_utc")
    windows = temporal.coalesce_states(states, ["delivery_interval_key"], ["known_from_utc"], "state_sha256")
    return windows.withColumn("history_key", surrogate_key("delivery_interval_key", readable_time(F.col("known_from_utc"))))


DIMENSIONS = {"dim_customer": "customer_master", "dim_site": "industrial_site_master", "dim_delivery_point": "delivery_point_assignment", "dim_contract": "contract_terms", "dim_meter": "revenue_meter_assignment"}


def dimensions(feeds: dict[str, DataFrame], facts: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """All dimensions: versions at their latest revision, their revision audits, calendar, intervals, statuses."""
    statuses = ["commitment_status", "delivery_status", "capacity_status", "contract_status", "access_status", "sla_status", "availability_status", "financial_status"]
    both = lambda *c: facts.select(*c).unionByName(history.select(*c))
    filled = both(*statuses).withColumn("capacity_status", F.coalesce("capacity_status", F.lit("missing")))
    out = {
        "dim_date": dim_date(both("operating_date").select(F.col("operating_date").alias("local_date"))), "dim_interval": dim_interval(both("interval_start_utc")), "dim_data_status": dim_data_status(filled, statuses),
    }
    for name, feed in DIMENSIONS.items():
        out[name] = current_of(feed, feeds[feed]).withColumn(f"{name[4:]}_key", surrogate_key(*_identity(feed)))
        out[f"{name}_revision_audit"] = history_of(feed, feeds[feed]).withColumn(f"{name[4:]}_revision_key", surrogate_key(*_identity(feed), "source_revision"))
    return out
