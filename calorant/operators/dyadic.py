"""Ranges of whole numbers as few aligned blocks of powers of four, so that a point meets the ranges that hold it by equality.

A range has at most six blocks a level, and a point one; both meet in exactly one block if the range
holds the point, and in none if not. With fewer levels than numbers need, a long range has more blocks of
the last one, and no block holds more than 4 ** levels numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levels_of(most: int) -> int:
    """The level at which one block holds the numbers from 0 to `most`."""
    n = 0
    while 4**n <= most:
        n += 1
    return n


def blocks(lo: str, hi: str, levels: int) -> Column:
    """Blocks (level, place) of [lo, hi), of levels up to `levels`; none if it is empty or an end is null."""
    up = lambda l: f"-shiftright(-({lo}), 2 * ({l}))"
    down = lambda l: f"shiftright({hi}, 2 * ({l}))"
    run = lambda a, b: f"if({a} < {b}, transform(sequence({a}, greatest({a}, {b} - 1)), p -> named_struct('level', l, 'place', p)), array())"
    a, b, c, d = up("l"), down("l"), f"4 * ({up('l + 1')})", f"4 * ({down('l + 1')})"
    each = f"if({c} >= {d} or l = {levels}, {run(a, b)}, concat({run(a, c)}, {run(d, b)}))"
    return F.expr(f"if({lo} < {hi}, flatten(transform(sequence(0, {levels}), l -> {each})), array())")


def places(at: str, levels: int) -> Column:
    """The block (level, place) of a number at each level; none if it is null or negative."""
    return F.expr(f"if({at} >= 0, transform(sequence(0, {levels}), l -> named_struct('level', l, 'place', shiftright({at}, 2 * l))), array())")


def held(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, lo: str, hi: str, levels: int) -> DataFrame:
    """Inner join of points with the ranges [lo, hi) of their keys that hold them: one row a pair, none to filter.

    at, lo and hi are columns of whole numbers. The sides share no columns but the keys.
    """
    p = points.withColumn("_block", F.explode(places(at, levels)))
    r = ranges.withColumn("_block", F.explode(blocks(lo, hi, levels)))
    deal = lambda df: df.withColumn("_level", F.col("_block.level")).withColumn("_place", F.col("_block.place")).drop("_block")
    return deal(p).join(deal(r), [*keys, "_level", "_place"]).drop("_level", "_place")
