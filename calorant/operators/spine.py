"""Dense half-hour grids over local days, whatever daylight saving does to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorant.functions.calendar import ZONE, half_hours
from calorant.functions.keys import readable_time, surrogate_key


def local_days(coverage: DataFrame) -> DataFrame:
    """coverage (start_date_local_inclusive, end_date_local_inclusive, ...) with a row for each operating_date."""
    return coverage.withColumn("operating_date", F.explode(F.sequence("start_date_local_inclusive", "end_date_local_inclusive")))


def half_hour_grid(days: DataFrame, zone: str = ZONE) -> DataFrame:
    """days with a row for each half hour: interval_number from 1, interval_start_utc, interval_end_utc."""
    grid = days.select("*", F.posexplode(half_hours(F.col("operating_date"), zone)).alias("_n", "interval_start_utc"))
    return grid.withColumns({"interval_number": F.col("_n") + 1, "interval_end_utc": F.col("interval_start_utc") + F.expr("interval 30 minutes")}).drop("_n")


def delivery_spine(coverage: DataFrame, assignments: DataFrame, zone: str = ZONE) -> DataFrame:
    """One row for each delivery point and half hour that a successful run covers and an assignment holds.

    A half hour covered by several runs stays one row, with the number of runs and their ids, sorted.
    Days are deduplicated before they become half hours, and every assignment meets its own days only:
    the grid of days is joined by day with the days of each assignment.
    """
    runs = local_days(coverage.where(F.col("reconciliation_status").isin("succeeded", "succeeded_with_quarantine")))
    days = runs.groupBy("operating_date").agg(F.countDistinct("pipeline_run_id").alias("covering_runs"), F.array_join(F.array_sort(F.collect_set("pipeline_run_id")), ",").alias("covering_run_ids"), F.min("generated_at_utc").alias("first_generated_at_utc"), F.max("generated_at_utc").alias("last_generated_at_utc"))
    span = days.agg(F.min("operating_date").alias("_a"), F.max("operating_date").alias("_b"))
    from_day, to_day = F.to_date("effective_from_utc"), F.coalesce(F.date_add(F.to_date("effective_to_utc"), 1), F.col("_b"))
    dated = assignments.join(F.broadcast(span)).withColumn("_first", F.greatest(F.date_sub(from_day, 1), F.col("_a"))).withColumn("_last", F.least(to_day, F.col("_b")))
    dated = dated.where("_first <= _last").withColumn("operating_date", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last", "_a", "_b")
    grid = half_hour_grid(days.join(dated, "operating_date"), zone)
    inside = grid.where((F.col("effective_from_utc") <= F.col("interval_start_utc")) & (F.col("effective_to_utc").isNull() | (F.col("interval_end_utc") <= F.col("effective_to_utc"))))
    return inside.withColumn("delivery_interval_key", surrogate_key("source_system_id", "delivery_point_natural_id", readable_time(F.col("interval_start_utc"))))


def gap_filled(df: DataFrame, keys: list[str], at: str, step: str = "30 minutes") -> DataFrame:
    """df with a row for every step between each key's first and last; what is missing stays null."""
    grid = df.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(at))
    return grid.join(df, [*keys, at], "left")
