"""Rows with the versions of their keys that hold an instant, without a product of a key's rows and versions.

Rows of one key and instant have the same versions, so these are found once an instant. Starts and ends
of versions and the rows' instants are put in one order per key and scanned once. An instant then knows
how many versions hold it, and the one that started last. If that one is in force and alone, as in any
history of disjoint windows, it is the answer. Instants that several versions hold, or an older one,
meet them by blocks of the ranks of instants (see `dyadic`), versions of one span together as a list.
Rows are joined to the lists of their instants last, and these are spread there: answers are neither
written nor dealt out. Joins are sorted ones throughout: Parquet's sizes of few columns are guessed far
too low to send a side to the driver by them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorant.operators import dyadic, scans
from calorant.plans.folders import settled

#: Versions in a list, about: more of one span are split over several lists.
MANY = 1024
#: Whether a pair of a row and a version counts, by the structs of both.
Keep = Callable[[Column, Column], Column]


def _events(df: DataFrame, versions: DataFrame, keys: list[str], start: str, end: str, at: str, closed: bool, parts: int | None, wanted: list[str], row: list[Column]) -> DataFrame:
    """Starts (_kind 1) and ends (0, or 3 if closed) of versions, and rows (2), in this order, with _active, _last and _rank at their instant.

    wanted: the columns of versions that _version and _last have; row: what rows have beside keys and instant.
    """
    sound = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) <= F.col(end) if closed else F.col(start) < F.col(end)))
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    v = settled(versions.where(sound).select(*keys, F.monotonically_increasing_id().alias("_id"), F.col(start).alias("_from"), F.col(end).alias("_to"), F.struct(*wanted).alias("_version")), "versions")
    edge = lambda t, by, *more: v.select(*keys, F.col(t).alias("_t"), F.lit(by).cast("long").alias("_by"), F.lit(1 if by > 0 else 3 if closed else 0).alias("_kind"), "_id", *more)
    rows = df.select(*keys, F.col(at).alias("_t"), F.lit(0).cast("long").alias("_by"), F.lit(2).alias("_kind"), *row)
    every = edge("_from", 1, "_version").unionByName(edge("_to", -1).where("_t is not null"), True).unionByName(rows, True)
    columns = {"_active": scans.sum_upto(F.col("_by")), "_last": scans.last_upto(F.col("_version")), "_rank": scans.dense_rank()}
    return scans.scanned(every, keys, ["_t", "_kind"], columns, parts)


def _answers(df: DataFrame, versions: DataFrame, keys: list[str], start: str, end: str, at: str, closed: bool, parts: int | None, wanted: list[str], whole: bool) -> tuple[DataFrame, int]:
    """keys, _t and _versions, a list of the versions that hold this instant of df, and how many one instant has at most.

    An instant that none holds has no row. One that several hold has a row for each span of time that
    versions have in common, or for a part of them where these are many; whole: one row with all of them,
    if no instant has more than MANY.
    """
    instants = df.select(*keys, at).where(" and ".join(f"`{c}` is not null" for c in [*keys, at])).distinct()
    events = settled(_events(instants, versions, keys, start, end, at, closed, parts, [*wanted, *({end} - set(wanted))], []), "events")
    held = events.where("_kind = 2 and _active > 0")
    until = F.col(f"_last.{end}")
    alone = (F.col("_active") == 1) & (until.isNull() | (F.col("_t") <= until if closed else F.col("_t") < until))
    shown = lambda version: F.struct(*(F.col(f"{version}.{c}") for c in wanted))
    out = held.where(alone).select(*keys, "_t", F.array(shown("_last")).alias("_versions"))
    rest = held.where(~alone).select(*keys, "_t", "_rank")
    most = events.agg(F.max("_rank"), F.max(F.when((F.col("_kind") == 2) & ~alone, F.col("_active")))).first()
    if most[1] is None:
        return out, 1
    first = events.where("_by > 0").select(*keys, "_id", shown("_version").alias("_version"), F.col("_rank").alias("_lo"))
    last = events.where("_by < 0").select("_id", F.col("_rank").alias("_hi"))
    spans = settled(first.join(last.hint("merge"), "_id", "left").withColumn("_hi", F.coalesce("_hi", F.lit(most[0] + 1))), "spans")
    longest, equal, n, of = spans.groupBy(*keys, "_lo", "_hi").count().agg(F.max(F.col("_hi") - F.col("_lo")), F.max("count"), F.count("*"), F.sum("count")).first()
    lists = spans.select(*keys, "_lo", "_hi", F.array("_version").alias("_versions"))
    if of >= 2 * n:  # else few have a span in common
        part = F.pmod(F.xxhash64("_id"), F.lit(-(-equal // MANY)).cast("long"))
        lists = spans.groupBy(*keys, "_lo", "_hi", part.alias("_part")).agg(F.collect_list("_version").alias("_versions")).drop("_part")
    found = dyadic.held(rest, lists.hint("merge"), keys, "_rank", "_lo", "_hi", dyadic.levels_of(longest)).select(*keys, "_t", "_versions")
    if whole and most[1] <= MANY:
        found = found.groupBy(*keys, "_t").agg(F.flatten(F.collect_list("_versions")).alias("_versions"))
    return out.unionByName(found), most[1]


def matched(df: DataFrame, versions: DataFrame, keys: list[str], start: str, end: str, at: str, keep: Keep | None = None, how: str = "left", closed: bool = False, parts: int | None = None, wanted: list[str] | None = None) -> DataFrame:
    """_row and _version, structs of a row and of a version [start, end) of its keys that holds `at` (a null end is open; closed: the end is held too).

    keep: what else a pair must fulfil. A row that no version holds comes once, with a null version
    (how: left) or not at all (inner). Null keys and instants match nothing, nor do empty versions.
    parts: as for scans.scanned, where one key has too many instants for a task. wanted: the columns that
    _version has, with those that keep asks for; all but the keys, if null.
    """
    wanted = [c for c in versions.columns if c not in keys] if wanted is None else wanted or [end]
    answers, most = _answers(df, versions, keys, start, end, at, closed, parts, wanted, keep is not None)
    kept = F.col("_versions") if keep is None else F.filter("_versions", lambda v: keep(F.col("_row"), v))
    of = lambda rows: rows.select(*(F.col(f"_row.{c}").alias(n) for n, c in [*((k, k) for k in keys), ("_t", at)]), *rows.columns)
    rows = df.select(F.struct(*df.columns).alias("_row"))
    if how != "left":
        return of(rows).join(answers.hint("merge"), [*keys, "_t"]).select("_row", F.explode(kept).alias("_version"))
    if keep is None or most <= MANY:  # a row that keeps none has no other row of answers
        return of(rows).join(answers.hint("merge"), [*keys, "_t"], "left").select("_row", F.explode_outer(kept).alias("_version"))
    rows = settled(rows.withColumn("_number", F.monotonically_increasing_id()), "rows")
    pairs = settled(of(rows).join(answers.hint("merge"), [*keys, "_t"]).select("_number", "_row", F.explode(kept).alias("_version")), "pairs")
    none = rows.join(pairs.select("_number").hint("merge"), "_number", "left_anti")
    return pairs.drop("_number").unionByName(none.select("_row", F.lit(None).cast(pairs.schema["_version"].dataType).alias("_version")))


def joined(df: DataFrame, versions: DataFrame, keys: list[str], start: str, end: str, at: str, keep: Keep | None = None, how: str = "left", hidden: tuple[str, ...] = (), closed: bool = False, parts: int | None = None) -> DataFrame:
    """All columns of df, and those of the versions matched, but keys and hidden ones."""
    shown = [c for c in versions.columns if c not in keys and c not in hidden]
    pairs = matched(df, versions, keys, start, end, at, keep, how, closed, parts, shown if keep is None else None)
    return pairs.select("_row.*", *(F.col(f"_version.`{c}`") for c in shown))


def active(df: DataFrame, versions: DataFrame, keys: list[str], start: str, end: str, at: str, parts: int | None = None) -> DataFrame:
    """All columns of df and active: the number of versions of its keys that hold `at`. Nothing is joined."""
    events = _events(df, versions, keys, start, end, at, False, parts, [start], [F.struct(*df.columns).alias("_row")]).where("_kind = 2")
    return events.select("_row.*", F.when(F.col("_t").isNull(), 0).otherwise(F.col("_active")).alias("active"))
