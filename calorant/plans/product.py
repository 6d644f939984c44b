"""Product queries over facts: scope, context, summary with gates, pages, history, chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorant.functions.measures import ENERGY, MONEY, percent
from calorant.operators import relations, spine, temporal

MOST_DAYS, MOST_ROWS, HISTORY_ROWS = 31, 200, 200


def status_filters() -> dict[str, Column]:
    """Predicates of the status filter by name."""
    return {
        "final": F.col("financial_status") == "final", "provisional": F.col("sla_status") == "provisional", "missing": F.col("commitment_status") == "missing",
        "corrected": F.col("corrected"), "shortfall": F.col("shortfall_mwh") > 0, "excess": F.col("excess_mwh") > 0,
    }


def scoped(df: DataFrame, authorized: Column, tenant: str, tenants: list, wanted: list[Column] = ()) -> DataFrame:
    """Rows that the actor may see, and of these those wanted. No tenant means no row, a null tenant never shows."""
    return df.where(authorized & F.col(tenant).isNotNull() & F.col(tenant).isin(*tenants)).where(relations.all_of(list(wanted)))


def summary(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Totals of facts by keys, or one row for all, even of none.

    Percentages are ratios of sums. Each is null unless its gate holds: commitments known for every
    interval, deliveries accepted (or capacities final) for every applicable one, and for money no
    interval's finance left open.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = df.groupBy(*keys).agg(
        F.sum("expected_count").alias("expected_count"), F.sum("commitment_count").alias("commitment_count"), zero(F.sum("applicable_count")).alias("applicable_count"), zero(F.sum("accepted_count")).alias("accepted_count"),
        zero(F.sum("final_capacity_count")).alias("final_capacity_count"), F.count_if(F.col("commitment_status").isin("missing", "withdrawn")).alias("missing_count"), F.count_if(F.col("financial_status") != "final").alias("open_financial_count"),
        *(F.sum(c).alias(c) for c in ("committed_mwh", "delivered_mwh", "shortfall_mwh", "excess_mwh", "billable_mwh", "unbilled_mwh", "sla_numerator_mwh", "availability_numerator_mwh", "gross_gbp")),
        F.sum("penalty_gbp").alias("penalty_all"), F.sum("net_gbp").alias("net_all"),
    )
    rows, applicable = zero(F.col("expected_count")), F.col("applicable_count")
    complete = (rows > 0) & (F.col("commitment_count") == rows) & (F.col("missing_count") == 0)
    delivery, capacity = complete & (F.col("accepted_count") == applicable), complete & (F.col("final_capacity_count") == applicable)
    finance = delivery & (F.col("open_financial_count") == 0)
    status = lambda gate: F.when(rows == 0, "no_data").when(complete & (applicable == 0), "not_applicable").when(gate, "final").otherwise("provisional")
    return total.withColumns({
        "commitments_complete": complete, "sla_status": status(delivery), "availability_status": status(capacity), "financial_status": F.when(rows == 0, "no_data").when(finance, "final").otherwise("provisional"),
        "sla_percent": F.when(delivery & (applicable > 0), percent(F.col("sla_numerator_mwh"), F.col("committed_mwh"))),
        "availability_percent": F.when(capacity & (applicable > 0), percent(F.col("availability_numerator_mwh"), F.col("committed_mwh"))),
        "penalty_gbp": F.when(finance, F.col("penalty_all")).cast(MONEY), "net_gbp": F.when(finance, F.col("net_all")).cast(MONEY),
        "pending_deliveries": F.greatest(applicable - F.col("accepted_count"), F.lit(0)), "pending_capacities": F.greatest(applicable - F.col("final_capacity_count"), F.lit(0)),
        "pending_commitments": F.greatest(rows - F.col("commitment_count"), F.lit(0)),
    }).drop("penalty_all", "net_all")


def context_tree(facts: DataFrame, authorized: Column, tenant: str, tenants: list, places: list[str], day: str) -> DataFrame:
    """The places that an actor may see, with the first and last day that each has facts for, in the places' order."""
    seen = scoped(facts, authorized, tenant, tenants)
    return seen.groupBy(*places).agg(F.min(day).alias("minimum_reporting_date"), F.max(day).alias("maximum_reporting_date")).orderBy(*places)


def intervals(facts: DataFrame, status: str | None, number: int, size: int) -> DataFrame:
    """A page of intervals in order of place and time, with the total; sizes up to MOST_ROWS."""
    if not 1 <= size <= MOST_ROWS or number < 1:
        raise ValueError(f"pages are of 1 to {MOST_ROWS} rows")
    rows = facts if status is None else facts.where(status_filters()[status])
    return relations.page(rows, [F.asc("delivery_point_natural_id"), F.asc("interval_start_utc"), F.asc("delivery_interval_key")], number, size)


def history(windows: DataFrame, interval_key: str, as_of=None) -> DataFrame:
    """An interval's knowledge windows, newest first, or the one known at as_of; truncated says if there are more."""
    rows = windows.where(F.col("delivery_interval_key") == interval_key)
    if as_of is not None:
        rows = rows.where(temporal.known_at(F.lit(as_of).cast("timestamp_ntz")))
    return relations.newest(rows, HISTORY_ROWS, [F.desc("known_from_utc")])


def chart_series(facts: DataFrame) -> DataFrame:
    """Every half hour between a place's first and last, with nulls for gaps and the signed exception."""
    filled = spine.gap_filled(facts.select("delivery_point_natural_id", "interval_start_utc", "committed_mwh", "delivered_mwh"), ["delivery_point_natural_id"], "interval_start_utc")
    return filled.withColumn("exception_mwh", (F.col("delivered_mwh") - F.col("committed_mwh")).cast(ENERGY))
