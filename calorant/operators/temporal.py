"""Revisions and knowledge time: current state, histories, as-known views, state windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorant.operators import asof, scans


def eligible(history: bool = False) -> Column:
    """Approved revisions; a knowledge history also needs the time of publication."""
    rule = (F.col("approval_state") == "approved") & F.col("approved_at_utc").isNotNull()
    return rule & F.col("published_at_utc").isNotNull() if history else rule


def before_start() -> Column:
    """An order counts only if it was published and approved before its interval began."""
    return (F.col("published_at_utc") < F.col("interval_start_utc")) & (F.col("approved_at_utc") < F.col("interval_start_utc"))


def latest_revision(df: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """One row per identity, the first by `order`. Never falls back past it, whatever its status."""
    w = Window.partitionBy(*identity).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def record_highs(df: DataFrame, identity: list[str], revision: str, clock: Column, tie: str, parts: int | None = None) -> DataFrame:
    """Rows whose revision is above all known before: with known_from_utc and prior_max_revision.

    Of several revisions at one instant only the highest counts, by `tie` among equals. parts, here and
    below: as for scans.scanned, where one identity has too many rows for a task.
    """
    df = df.withColumn("known_from_utc", clock)
    one = latest_revision(df, [*identity, "known_from_utc"], [F.col(revision).desc(), F.col(tie).desc()])
    seen = scans.scanned(one, identity, ["known_from_utc"], {"prior_max_revision": scans.max_before(F.col(revision))}, parts)
    return seen.where(F.col("prior_max_revision").isNull() | (F.col(revision) > F.col("prior_max_revision")))


def closed(df: DataFrame, identity: list[str], parts: int | None = None) -> DataFrame:
    """known_to_utc: when the next row of the identity is known; null for the last."""
    return scans.scanned(df, identity, ["known_from_utc"], {"known_to_utc": scans.following(F.col("known_from_utc"))}, parts)


def knowledge_history(df: DataFrame, identity: list[str], revision: str, clock: Column, tie: str, parts: int | None = None) -> DataFrame:
    """Windows [known_from_utc, known_to_utc) of each identity's record-high revisions."""
    return closed(record_highs(df, identity, revision, clock, tie, parts), identity, parts)


def capacity_history(df: DataFrame, identity: list[str], revision: str, clock: Column, tie: str, status: str, parts: int | None = None) -> DataFrame:
    """Like knowledge_history, but once a final or withdrawn assessment is known, provisional ones don't count."""
    high = record_highs(df.where(F.col(status).isin("provisional", "final", "withdrawn")), identity, revision, clock, tie, parts)
    settled = scans.scanned(high, identity, ["known_from_utc"], {"_settled": scans.count_upto(F.col(status).isin("final", "withdrawn"))}, parts)
    kept = settled.where(~((F.col(status) == "provisional") & (F.col("_settled") > 0))).drop("_settled")
    return closed(kept, identity, parts)


def known_at(t: Column, start: Column | str = "known_from_utc", end: Column | str = "known_to_utc") -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (start <= t) & (end.isNull() | (t < end))


def as_known_at(df: DataFrame, history: DataFrame, keys: list[str], t: str, how: str = "left", parts: int | None = None) -> DataFrame:
    """df with the history row of its keys that was known at its column t."""
    h = history.select(*(F.col(c).alias(c if c in keys else f"h_{c}" if c in df.columns else c) for c in history.columns))
    start, end = ("h_known_from_utc" if "known_from_utc" in df.columns else "known_from_utc"), ("h_known_to_utc" if "known_to_utc" in df.columns else "known_to_utc")
    return asof.joined(df, h, keys, start, end, t, how=how, parts=parts)


def coalesce_states(df: DataFrame, identity: list[str], order: list[str], fingerprint: str, parts: int | None = None) -> DataFrame:
    """Rows whose fingerprint differs from the one before, the first included, with known_to_utc from the next kept."""
    seen = scans.scanned(df, identity, order, {"_previous": scans.previous(F.col(fingerprint))}, parts)
    changed = seen.where(F.col("_previous").isNull() | (F.col(fingerprint) != F.col("_previous"))).drop("_previous")
    return scans.scanned(changed, identity, order, {"known_to_utc": scans.following(F.col(order[0]))}, parts)


def change_points(logs: list[DataFrame]) -> DataFrame:
    """Distinct rows of logs with equal columns: every instant at which an input could change."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.distinct()


def related_points(links: DataFrame, clocks: DataFrame, owner: str, relation: str, at: str) -> DataFrame:
    """Distinct (owner, at): the instants of each owner's own links and of the clocks of all owners that share a relation with it.

    links: owner, relation, at; clocks: owner, at. A relation's instants go to its owners as sets, not one by
    one: days as two bytes each, together by their time of day. A set has 65,536 at most; those of one owner
    are joined in one row. Instants may be null; null owners have their own links, null relations share nothing.
    """
    kind = clocks.schema[at].dataType
    links, day = links.repartition(owner), F.unix_date(F.to_date(at))
    block = F.shiftright(day + 32768, 16)
    cut = lambda df, *more: df.select(*more, (F.col(at) - F.to_date(at).cast(df.schema[at].dataType)).alias("_time"), block.alias("_block"), (day - block * 65536).cast("smallint").alias("_day"))
    own = cut(links, owner).groupBy(owner, "_time", "_block").agg(F.collect_set("_day").alias("_days"))
    of = links.select(owner, relation).where(F.col(relation).isNotNull()).join(clocks.select(owner, at), owner)
    sets = cut(of, relation).repartition(relation).groupBy(relation, "_time", "_block").agg(F.collect_set("_day").alias("_days"))
    met = links.select(owner, relation).join(sets, relation).select(owner, "_time", "_block", "_days").unionByName(own)
    days = met.repartition(owner).groupBy(owner, "_time", "_block").agg(F.array_distinct(F.flatten(F.collect_list("_days"))).alias("_days"))
    each = days.select(owner, "_time", "_block", F.explode_outer("_days").alias("_day"))
    return each.select(owner, (F.date_from_unix_date(F.col("_block") * 65536 + F.col("_day")).cast(kind) + F.col("_time")).alias(at))


def bitemporal_join(df: DataFrame, history: DataFrame, keys: list[str], begin: str, end: str, t: str, parts: int | None = None) -> DataFrame:
    """df with the version of its keys that was in force over [begin, end] as far as known at t; a left join.

    Versions are found by the instant of the effective time, of which each key has many, and kept by
    what was known and by the end.
    """
    keep = lambda row, v: known_at(row[t], v["known_from_utc"], v["known_to_utc"]) & (v["effective_to_utc"].isNull() | (row[end] <= v["effective_to_utc"]))
    hidden = ("known_from_utc", "known_to_utc", "effective_from_utc", "effective_to_utc")
    return asof.joined(df, history, keys, "effective_from_utc", "effective_to_utc", begin, keep, hidden=hidden, closed=True, parts=parts)
