"""Running values over ordered groups, in two levels, so that a group of any size is spread over many tasks.

Rows are dealt out by ranges of group and order and written. Inside a range a window gives each row's
value as far as the range goes. Of each group and range one row is left, and what its ranges before
(or after) hold is carried to it; only groups that cross a border need this, two a range at most, so
the carries are broadcast. Without `parts` the same values come of one window, a task a group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from calorant.plans.folders import settled

_START, _END = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Scan:
    """A running value: what a row sees, by kind, of the rows before it (or after it) in its group."""

    kind: str
    value: Column

    def local(self, w: WindowSpec) -> Column:
        """The value within a range, by a window in order."""
        upto, before = w.rowsBetween(_START, Window.currentRow), w.rowsBetween(_START, -1)
        return {
            "dense_rank": lambda: F.dense_rank().over(w).cast("long"), "max_before": lambda: F.max(self.value).over(before), "sum_upto": lambda: F.coalesce(F.sum(self.value).over(upto), F.lit(0)),
            "last_upto": lambda: F.last(self.value, ignorenulls=True).over(upto), "previous": lambda: F.lag(F.struct(self.value)).over(w), "next": lambda: F.lead(F.struct(self.value)).over(w),
        }[self.kind]()

    def whole(self, order: Column) -> Column:
        """What a range holds for others, as an aggregate; order is the rows' order as one value."""
        return {
            "dense_rank": lambda: F.count_distinct(order), "max_before": lambda: F.max(self.value), "sum_upto": lambda: F.coalesce(F.sum(self.value), F.lit(0)),
            "last_upto": lambda: F.max_by(self.value, F.when(self.value.isNotNull(), order)), "previous": lambda: F.max_by(F.struct(self.value), order), "next": lambda: F.min_by(F.struct(self.value), order),
        }[self.kind]()

    def carried(self, whole: Column, w: WindowSpec) -> Column:
        """What comes to a range from those before, or the next."""
        before = w.rowsBetween(_START, -1)
        return {
            "dense_rank": lambda: F.sum(whole).over(before), "max_before": lambda: F.max(whole).over(before), "sum_upto": lambda: F.sum(whole).over(before), "last_upto": lambda: F.last(whole, ignorenulls=True).over(before),
            "previous": lambda: F.lag(whole).over(w), "next": lambda: F.lead(whole).over(w),
        }[self.kind]()

    def both(self, local: Column, carry: Column) -> Column:
        if self.kind == "max_before":
            return F.greatest(local, carry)
        if self.kind in ("dense_rank", "sum_upto"):
            return local + F.coalesce(carry, F.lit(0))
        return F.coalesce(local, carry)

    def finished(self, value: Column) -> Column:
        return value["value"] if self.kind in ("previous", "next") else value


def max_before(value: Column) -> Scan:
    """The greatest of the rows before."""
    return Scan("max_before", value)


def sum_upto(value: Column) -> Scan:
    """The sum up to and with the row; 0 of none."""
    return Scan("sum_upto", value)


def count_upto(condition: Column) -> Scan:
    return Scan("sum_upto", F.when(condition, 1).otherwise(0).cast("long"))


def dense_rank() -> Scan:
    """The number of different values of the order up to and with the row's."""
    return Scan("dense_rank", F.lit(None))


def last_upto(value: Column) -> Scan:
    """The last value up to the row that isn't null."""
    return Scan("last_upto", value)


def previous(value: Column) -> Scan:
    """The row's before; null for the first."""
    return Scan("previous", value.alias("value"))


def following(value: Column) -> Scan:
    """The next row's; null for the last."""
    return Scan("next", value.alias("value"))


def scanned(df: DataFrame, group: list[str], order: list[str], columns: dict[str, Scan], parts: int | None = None) -> DataFrame:
    """df with running values of each group in ascending order (nulls first); rows equal by `order` take any order among them.

    parts: the number of ranges to split all rows into, for groups too large for one task; null for one
    window. A null in a group column is a group. Columns of these names are replaced.
    """
    if parts is None:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumns({name: s.finished(s.local(w)) for name, s in columns.items()})
    range_of = "_".join(["_range", *df.columns])
    made = {name: f"{range_of}_{k}" for k, name in enumerate(columns)}
    dealt = settled(df.repartitionByRange(parts, *group, *order).withColumn(range_of, F.spark_partition_id()), "scan")
    w = Window.partitionBy(range_of, *group).orderBy(*order)
    local = dealt.withColumns({made[name]: s.local(w) for name, s in columns.items()})
    at = F.struct(*order)
    wholes = dealt.groupBy(*group, range_of).agg(*(s.whole(at).alias(made[name]) for name, s in columns.items()))
    across = Window.partitionBy(*group).orderBy(range_of)
    carries = wholes.withColumn("_ranges", F.count("*").over(Window.partitionBy(*group))).where("_ranges > 1")
    carries = carries.select(range_of, *(F.col(c).alias(f"{range_of}_g{k}") for k, c in enumerate(group)), *(s.carried(F.col(made[name]), across).alias(f"{made[name]}_carry") for name, s in columns.items()))
    same = reduce(lambda a, b: a & b, (local[c].eqNullSafe(carries[f"{range_of}_g{k}"]) for k, c in enumerate(group)), local[range_of] == carries[range_of])
    joined = local.join(F.broadcast(carries), same, "left")
    out = {name: s.finished(s.both(local[made[name]], carries[f"{made[name]}_carry"])).alias(name) for name, s in columns.items()}
    return joined.select(*(local[c] for c in df.columns if c not in columns), *out.values())
