"""Joins on ranges of time, overlaps, and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorant.operators import asof, dyadic, scans

#: Levels of blocks of four: the units that a span of time is cut into are 4 ** LEVELS.
LEVELS = 10
#: The level of the largest blocks that ranges are cut into: 4 ** (LEVELS - TOP) of them over the time, so that no task gets all points as members of one block.
TOP = 6


def covers(start: str, end: str, begin: Column, stop: Column | None = None) -> Column:
    """Whether [start, end) holds begin (and all of [begin, stop]); an open end holds all after its start."""
    inside = (begin < F.col(end)) if stop is None else (stop <= F.col(end))
    return (F.col(start) <= begin) & (F.col(end).isNull() | inside)


def effective_join(df: DataFrame, versions: DataFrame, keys: list[str], start: str, end: str, at: str, until: str | None = None, how: str = "left", hidden: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """df with the version of its keys that is in force at `at` (or over [at, until]), without the version's hidden columns."""
    keep = None if until is None else lambda row, version: version[end].isNull() | (row[until] <= version[end])
    return asof.joined(df, versions, keys, start, end, at, keep, how, hidden, closed=until is not None, parts=parts)


def containment_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Inner join of points with the ranges [start, end) that hold them, without a key in common.

    The time from the first to the last point is cut into a million units. A range, clipped to that
    time, enters at most 300 blocks of units, however long or open it is, and a point one block a level up to
    TOP; what the units at a range's ends hold beside it is filtered.
    """
    micros = lambda t: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t)
    bounds = points.agg(F.min(micros(F.col(at))).alias("_first"), F.max(micros(F.col(at))).alias("_last")).withColumn("_unit", F.greatest(F.lit(1), F.ceil((F.col("_last") - F.col("_first") + 1) / 4**LEVELS)))
    unit = lambda t: F.floor((t - F.col("_first")) / F.col("_unit"))
    begin, stop = F.greatest(micros(F.col(start)), F.col("_first")), F.least(F.coalesce(micros(F.col(end)) - 1, F.col("_last")), F.col("_last"))
    clipped = ranges.join(F.broadcast(bounds)).where(F.col(start).isNotNull() & (begin <= stop)).withColumns({"_lo": unit(begin), "_hi": unit(stop) + 1})
    placed = points.join(F.broadcast(bounds)).withColumn("_at", unit(micros(F.col(at))))
    pairs = dyadic.held(placed.select(F.struct(*points.columns).alias("_p"), "_at"), clipped.select(F.struct(*ranges.columns).alias("_r"), "_lo", "_hi"), [], "_at", "_lo", "_hi", TOP)
    return pairs.where(covers(f"_r.{start}", f"_r.{end}", F.col(f"_p.{at}"))).select("_p.*", "_r.*")


def _far(end: str) -> Column:
    return F.coalesce(F.col(end), F.lit("9999-12-31").cast("timestamp_ntz"))


def overlapping(df: DataFrame, group: list[str], start: str, end: str, tie: str, parts: int | None = None) -> DataFrame:
    """Rows that overlap another of their group, in one pass: the latest end before, and the next start."""
    seen = scans.scanned(df.withColumn("_far", _far(end)), group, [start, tie], {"_before": scans.max_before(F.col("_far")), "_next": scans.following(F.col(start))}, parts)
    return seen.where((F.col("_before") > F.col(start)) | (F.col("_next") < F.col("_far"))).drop("_far", "_before", "_next")


def overlap_counts(df: DataFrame, group: list[str], start: str, end: str, key: str, parts: int | None = None) -> DataFrame:
    """group, key and overlaps: how many other rows of its group each row overlaps. No pairs are made.

    key is unique in a group. Those that start before a row's end, less those that ended by its start and
    the row itself. Rows that are empty, or have no start, overlap nothing and nothing overlaps them.
    """
    rows = df.select(*group, key, F.col(start).alias("_a"), _far(end).alias("_b"))
    sound = rows.where("_a < _b")
    at = lambda t, kind: sound.select(*group, key, F.col(t).alias("_t"), F.lit(kind).alias("_kind"))
    begun, gone = scans.count_upto(F.col("_kind") == 1), scans.count_upto(F.col("_kind") == 0)
    seen = scans.scanned(at("_b", 0).unionByName(at("_a", 1)), group, ["_t", "_kind"], {"_begun": begun, "_gone": gone}, parts)
    each = seen.groupBy(*group, key).agg((F.sum(F.when(F.col("_kind") == 0, F.col("_begun")).otherwise(-F.col("_gone"))) - 1).alias("overlaps"))
    return each.unionByName(rows.where("not coalesce(_a < _b, false)").select(*group, key, F.lit(0).cast("long").alias("overlaps")))


def overlapping_pairs(df: DataFrame, group: list[str], start: str, end: str, key: str) -> DataFrame:
    """Pairs (left_<key>, right_<key>) of overlapping rows of a group; only rows that overlap at all are paired."""
    rows = overlapping(df, group, start, end, key).withColumn("_far", F.coalesce(F.col(end), F.lit("9999-12-31").cast("timestamp_ntz")))
    match = (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.col(f"a.{start}") < F.col("b._far")) & (F.col(f"b.{start}") < F.col("a._far"))
    for g in group:
        match = match & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    return rows.alias("a").join(rows.alias("b"), match).select(*(F.col(f"a.{g}") for g in group), F.col(f"a.{key}").alias(f"left_{key}"), F.col(f"b.{key}").alias(f"right_{key}"))


def coverage(df: DataFrame, key: str, versions: DataFrame, keys: list[str], start: str, end: str, at: str, until: str | None = None, parts: int | None = None) -> DataFrame:
    """key and coverage of each row: missing, ok or ambiguous for none, one or several versions in force. Instants are counted without a join."""
    said = lambda n: F.when(n == 0, "missing").when(n == 1, "ok").otherwise("ambiguous").alias("coverage")
    if until is None:
        return asof.active(df, versions, keys, start, end, at, parts).groupBy(key).agg(said(F.sum("active")))
    found = effective_join(df, versions.withColumn("_hit", F.lit(1)), keys, start, end, at, until, parts=parts)
    return found.groupBy(key).agg(said(F.count("_hit")))
