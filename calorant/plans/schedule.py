"""Daily requests: which local operating day a noon-to-noon interval stands for, and by when it is due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorant.functions.calendar import local_time, utc_time

#: The first operating day, and the local hours of the boundary and of the deadline.
FIRST_DAY = "2026-01-01"
BOUNDARY_HOUR, DEADLINE_HOUR = 12, 16


def daily_requests(intervals: DataFrame, start: str, end: str, first_day: str = FIRST_DAY) -> DataFrame:
    """intervals (start and end as UTC instants) with operating_date, trigger_run_id, expected_ready_by_utc and issue.

    The operating day is the local day on which the interval starts, whether it has 23, 24 or 25
    hours. issue names why a row stands for no day: an end off local noon, days that don't follow
    each other, or a day before first_day; the other columns are null then.
    """
    begin, stop = local_time(F.col(start)), local_time(F.col(end))
    noon = lambda t: F.date_format(t, "HH:mm:ss.SSSSSS") == f"{BOUNDARY_HOUR}:00:00.000000"
    day = F.to_date(begin)
    issue = (
        F.when(~F.coalesce(noon(begin) & noon(stop), F.lit(False)), "not_local_noon")
        .when(F.to_date(stop) != F.date_add(day, 1), "days_not_consecutive")
        .when(day < F.lit(first_day).cast("date"), "before_first_day")
    )
    due = utc_time(F.date_add(day, 1).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(DEADLINE_HOUR)))
    sound = lambda c: F.when(issue.isNull(), c)
    return intervals.withColumns({"operating_date": sound(day), "trigger_run_id": sound(F.concat(F.lit("daily__"), F.date_format(day, "yyyyMMdd"))), "expected_ready_by_utc": sound(due), "issue": issue})
