"""Stored types against a contract's decimals: which columns differ, and how many values don't fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, IntegralType, NumericType

#: Wide enough for what is stored, in digits before and after the point.
WIDE = "decimal(38,12)"


def conformance(df: DataFrame, decimals: dict[str, tuple[int, int]]) -> DataFrame:
    """column_name, stored_type, declared_type, state, rows, nulls, over_scale and over_precision of each declared decimal.

    state: missing (no such column), not_numeric, exact (the declared type), wider or narrower (another
    decimal that does, or doesn't, hold all that the declared one does), or inexact (whole numbers and
    floats). A value is over scale if it has more digits after the point than declared, and over
    precision if it has more before it, after rounding; such that WIDE can't hold, or not finite, are both.
    Counts are null where there is nothing to count; one pass over the table counts all columns.
    """
    stored = {f.name: f.dataType for f in df.schema}
    numeric = {c: ps for c, ps in decimals.items() if isinstance(stored.get(c), NumericType)}
    sums = [F.count("*").alias("rows")]
    for k, (c, (p, s)) in enumerate(numeric.items()):
        v = F.col(f"`{c}`").try_cast(WIDE)
        lost = F.col(f"`{c}`").isNotNull() & v.isNull()
        sums += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}"), F.count_if(lost | (F.round(v, s) != v)).alias(f"s{k}"), F.count_if(lost | (F.abs(F.round(v, s)) >= F.lit(10 ** (p - s)))).alias(f"p{k}")]
    counted = df.agg(*sums)
    place = {c: k for k, c in enumerate(numeric)}
    rows = []
    for c, (p, s) in decimals.items():
        kind, k = stored.get(c), place.get(c)
        held = [F.lit(None).cast("long")] * 4 if k is None else [F.col("rows"), F.col(f"n{k}"), F.col(f"s{k}"), F.col(f"p{k}")]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind and kind.simpleString()).cast("string").alias("stored_type"), F.lit(f"decimal({p},{s})").alias("declared_type"), F.lit(_state(kind, p, s)).alias("state"), *(x.alias(n) for x, n in zip(held, ("rows", "nulls", "over_scale", "over_precision")))))
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _state(kind, precision: int, scale: int) -> str:
    if kind is None:
        return "missing"
    if isinstance(kind, DecimalType):
        if (kind.precision, kind.scale) == (precision, scale):
            return "exact"
        return "wider" if kind.scale >= scale and kind.precision - kind.scale >= precision - scale else "narrower"
    return "inexact" if isinstance(kind, (IntegralType, DoubleType, FloatType)) else "not_numeric"
