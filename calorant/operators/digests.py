"""Trees of content digests over key hashes: two versions of a table are compared from the top down.

A row belongs to a leaf by the hash of its key. A leaf's digest is its number of rows and the sum of their
256-bit hashes, in eight words, so that no order changes it and repeated rows do; a node's is the sum
of its children's. Rows are read only in leaves whose digests differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calorant.operators import relations

#: Children of a node, as bits of the key's hash, and levels below the root.
BITS, DEPTH = 4, 3
WORDS = [f"w{k}" for k in range(8)]
#: Differing leaves that a scan is told of; beyond, it reads all rows.
LISTED = 2_000


def leaf(keys: list[str], depth: int = DEPTH) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - BITS * depth)


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row's values in the order of their columns' names; null and text differ."""
    return F.sha2(F.to_json(F.struct(*(df[c].cast("string").alias(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)


def tree(df: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """level (0 is the root), node, rows and w0 to w7 of every node that has rows. Leaves are summed before anything is shuffled."""
    hashed = df.select(leaf(keys, depth).alias("node"), row_hash(df).alias("h"))
    word = lambda k: F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    leaves = hashed.groupBy("node").agg(F.count("*").alias("rows"), *(F.sum(word(k)).alias(w) for k, w in enumerate(WORDS)))
    levels = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("node", F.expr(f"shiftright(node, {BITS} * ({depth} - level))"))
    return levels.groupBy("level", "node").agg(F.sum("rows").alias("rows"), *(F.sum(w).alias(w) for w in WORDS))


def publish(df: DataFrame, keys: list[str], path: str, depth: int = DEPTH) -> None:
    """Rows by leaf below path/rows, so that a scan for few leaves skips the rest, and their tree at path/tree."""
    placed = df.withColumn("_leaf", leaf(keys, depth))
    placed.repartitionByRange("_leaf").sortWithinPartitions("_leaf").write.parquet(f"{path}/rows")
    tree(df, keys, depth).coalesce(1).write.parquet(f"{path}/tree")


def differing(spark: SparkSession, base: str, following: str, depth: int = DEPTH) -> list[int]:
    """Leaves whose digests differ, found level by level below nodes that differ."""
    a, b = (spark.read.parquet(f"{p}/tree") for p in (base, following))
    names = {w: f"_{w}" for w in ["rows", *WORDS]}
    both = a.join(b.withColumnsRenamed(names), ["level", "node"], "full")
    same = F.lit(True)
    for w, other in names.items():
        same = same & F.col(w).eqNullSafe(F.col(other))
    nodes = [0]
    for level in range(depth + 1):
        below = [n * (level and 2**BITS) + k for n in nodes for k in range(2**BITS if level else 1)]
        nodes = sorted(r.node for r in both.where(F.col("level") == level).where(F.col("node").isin(below)).where(~same).select("node").collect())
        if not nodes:
            return []
    return nodes


def rows_of(spark: SparkSession, path: str, leaves: list[int]) -> DataFrame:
    """Rows of some leaves: the filter reaches the files, which are sorted by leaf."""
    rows = spark.read.parquet(f"{path}/rows")
    return (rows.where(F.col("_leaf").isin(leaves)) if len(leaves) <= LISTED else rows).drop("_leaf")


def changes(spark: SparkSession, base: str, following: str, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """keys and change (insert, update, delete) of what differs between two published versions; rows are read in differing leaves alone."""
    leaves = differing(spark, base, following, depth)
    return relations.compared(rows_of(spark, base, leaves), rows_of(spark, following, leaves), keys).where("change <> 'unchanged'")
