"""Aggregates, comparisons and set operations that the plans share."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calorant.operators import scans
from calorant.plans.folders import settled

#: Rows up to which a page is found by a top-k.
TOP = 10_000


def only(value: Column | str) -> Column:
    """The group's value if it has one row, else null."""
    return F.when(F.count("*") == 1, F.max(value))


def sorted_set(value: Column | str, separator: str = ",") -> Column:
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def compared(base: DataFrame, following: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change of every key in either: insert, update, delete or unchanged, by all other columns.

    Both sides are hashed to a row each by key before the join, so that whole rows aren't shuffled.
    """
    own = [c for c in base.columns if c not in keys]
    text = lambda df: F.to_json(F.struct(*(df[c] for c in own)), {"ignoreNullFields": "false"})
    a = base.select(*keys, F.sha2(text(base), 256).alias("_a"))
    b = following.select(*keys, F.sha2(text(following), 256).alias("_b"))
    change = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("update")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def applied(base: DataFrame, following: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base without deleted and updated keys, and with the inserted and updated rows of the following."""
    gone = changes.where(F.col("change").isin("delete", "update")).select(*keys)
    new = changes.where(F.col("change").isin("insert", "update")).select(*keys)
    return base.join(gone, keys, "left_anti").select(*base.columns).unionByName(following.join(new, keys, "left_semi").select(*base.columns))


def profile(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Rows, distinct keys, first and last date, and a hash of the content that no order changes.

    Rows' hashes are added up, so nothing is sorted or gathered; a repeated row changes the sum.
    """
    row = F.sha2(F.concat_ws("|", *(F.coalesce(df[c].cast("string"), F.lit("<null>")) for c in sorted(df.columns))), 256)
    low = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(
        F.count("*").alias("row_count"), F.countDistinct(*keys).alias("key_count"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.sum(low).cast("string").alias("content_sum")
    )


def any_of(rules: dict[str, Column]) -> Column:
    """Codes of the rules that hold; a rule that is null doesn't."""
    return F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())), lambda c: c.isNotNull())


def reason_counts(df: DataFrame, issues: str) -> DataFrame:
    return df.select(F.explode(issues).alias("code")).groupBy("code").agg(F.count("*").alias("rows"))


def load_classes(incoming: DataFrame, stored: DataFrame, identity: str, payload: str) -> DataFrame:
    """incoming with load_class: new, replay (the same payload is stored) or conflict."""
    held = stored.groupBy(identity).agg(F.min(payload).alias("_held"))
    kind = F.when(F.col("_held").isNull(), "new").when(F.col("_held") == F.col(payload), "replay").otherwise("conflict")
    return incoming.join(held, identity, "left").withColumn("load_class", kind).drop("_held")


def contrary(df: DataFrame, identity: list[str], payload: str) -> DataFrame:
    """Identities with several payloads, without gathering them."""
    return df.groupBy(*identity).agg(F.min(payload).alias("_a"), F.max(payload).alias("_b")).where("_a <> _b").select(*identity)


def resolved_duplicates(df: DataFrame, identity: list[str], payload: str, line: str) -> DataFrame:
    """df with duplicate_class: conflict for all rows of a contrary identity, else accepted for the lowest line and replay.

    line is unique within an identity. Each identity is reduced before it is joined, and never gathered in one task.
    """
    names = {c: f"_id_{i}" for i, c in enumerate(identity)}
    whole = df.groupBy(*(F.col(c).alias(n) for c, n in names.items())).agg((F.min(payload) != F.max(payload)).alias("_clash"), F.min(line).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    kind = F.when(F.col("_clash"), "conflict").when(F.col(line).eqNullSafe(F.col("_first")), "accepted").otherwise("replay")
    return df.join(whole, same).withColumn("duplicate_class", kind).drop(*names.values(), "_clash", "_first")


def newest(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows and truncated: whether there are more. Reads n + 1 rows of a distributed top-k."""
    top = df.orderBy(*order).limit(n + 1)
    w = Window.orderBy(*order)
    numbered = top.withColumn("_n", F.row_number().over(w)).withColumn("truncated", F.max("_n").over(Window.partitionBy()) > n)
    return numbered.where(F.col("_n") <= n).drop("_n")


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = TOP, parts: int | None = None) -> DataFrame:
    """A page of rows with the total of all rows as total_rows.

    The first `most` rows are found by a top-k. A later page is located: rows are dealt out by ranges of
    the order and written, ranges are counted, and only those that hold the page are read and sorted; a
    page past the end reads none. A page past the last row is one row of nulls with the total, so that
    this isn't lost. Offsets may exceed 32 bits. Sizes up to `most`.
    """
    if not 1 <= size <= most or number < 1:
        raise ValueError(f"pages are of 1 to {most} rows")
    offset = (number - 1) * size
    if offset + size <= most:
        total, rows = df.agg(F.count("*").alias("total_rows")), df.orderBy(*order).offset(offset).limit(size)
    else:
        name = "_".join(["_range", *df.columns])
        own = [parts] if parts else []
        dealt = settled(df.repartitionByRange(*own, *order).withColumn(name, F.spark_partition_id()), "ranges")
        counts = [tuple(r) for r in dealt.groupBy(name).count().orderBy(name).collect()]
        upto = list(itertools.accumulate(n for _, n in counts))
        held = [(k, end - n) for (k, n), end in zip(counts, upto) if end > offset and end - n < offset + size]
        rows = dealt.where(F.col(name).isin([k for k, _ in held])).drop(name)
        rows = rows.orderBy(*order).offset(offset - held[0][1]).limit(size) if held else rows
        total = dealt.sparkSession.range(1).select(F.lit(upto[-1] if upto else 0).cast("long").alias("total_rows"))
    return total.join(F.broadcast(rows), F.lit(True), "left").select(*df.columns, "total_rows")


def nearest_ranks(df: DataFrame, group: list[str], column: str, percents: list[int], parts: int | None = None) -> DataFrame:
    """group and p<percent>: the least value that so many of a group's rows don't exceed; null of none.

    Distinct values are counted, their counts summed in order, and the values at the ranks picked, so
    that no task holds a group's values. parts: as for scans.scanned, for groups too large to sort in a task.
    """
    totals = df.groupBy(*group).agg(F.count(column).alias("_rows"))
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("_n"))
    seen = scans.scanned(counts, group, [column], {"_upto": scans.sum_upto(F.col("_n"))}, parts)
    names = {c: f"_g{k}" for k, c in enumerate(group)}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], F.lit(True))
    rank = lambda p: F.floor((F.col("_rows") * p + 99) / 100)
    at = lambda p: (F.col("_upto") >= rank(p)) & (F.col("_upto") - F.col("_n") < rank(p))
    found = seen.withColumnsRenamed(names).join(totals, same) if group else seen.join(F.broadcast(totals))
    picked = found.where(reduce(lambda a, b: a | b, [at(p) for p in percents])).groupBy(*names.values()).agg(*(F.max(F.when(at(p), F.col(column))).alias(f"p{p}") for p in percents))
    return totals.join(picked, same, "left").select(*group, *(f"p{p}" for p in percents)) if group else picked


def all_of(rules: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, rules, F.lit(True))
