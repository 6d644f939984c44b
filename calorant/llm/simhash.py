"""SimHash near-duplicate groups, with pivot distance tables to discard pairs.

Distinct fingerprints are dealt to blocks: fingerprints at most two bits apart agree in two of four
16-bit parts, so each is entered under its six pairs of parts. Every fingerprint carries its Hamming
distances to sixteen reference fingerprints (the pivot table). By the triangle inequality no
coordinate of a linked pair differs by more than the distance allowed, so a pair of a block whose
largest coordinate difference is more is discarded before its own distance is counted.

A block with many members isn't paired, as pairs would grow with the square of its size. Its members enter the 65 fingerprints at distance one or
less of themselves instead: two fingerprints are at most two bits apart exactly if they meet there.
Each is then linked with the smallest at the same place, which keeps every group connected with rows
in proportion to the members, however close the members are.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorant.llm.common import checkpoint, encoded, give_back, text_slices
from calorant.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
BLOCK = 16
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {i}") - (1 << 63) for i in range(16)]


def fingerprint_batch(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints (as int64) of texts: a bit is set if over half the shingles' hashes have it."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, j in text_slices(texts, 1_000_000):
        hashes: list[int] = []
        counts = []
        for t in texts[i:j]:
            words = t.lower().split()
            if len(words) > shingle:
                own = [digest(b" ".join(w), SEED) for w in zip(*(words[k:] for k in range(shingle)))]
            else:
                own = [digest(b" ".join(words), SEED)] if words else []
            counts.append(len(own))
            hashes += own
        n = np.array(counts)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(n) - n)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little")
        out[i + full] = packed.view("<u8").ravel()
    return out.view(np.int64)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text as long; zero for null."""

    @F.pandas_udf("long")
    def of(column: pd.Series) -> pd.Series:
        out = pd.Series(fingerprint_batch(encoded(column), shingle))
        give_back()
        return out

    return of(text)


def pivot_table(fp: Column) -> list[Column]:
    """Distances to the sixteen pivots, eight to a long in seven bits each."""
    each = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in PIVOTS]
    return [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(d, 7 * k) for k, d in enumerate(each[h : h + 8])]).alias(f"pivots{h // 8}") for h in (0, 8)]


def largest_difference(left: str, right: str) -> Column:
    """The largest coordinate difference of two rows' pivot tables."""
    part = lambda side, i: F.shiftright(F.col(f"{side}.pivots{i // 8}"), 7 * (i % 8)).bitwiseAND(F.lit(127))
    return F.greatest(*(F.abs(part(left, i) - part(right, i)) for i in range(len(PIVOTS))))


def _blocks(fp: Column) -> list[Column]:
    """Keys of the six pairs of 16-bit parts: the pair's number, then both parts."""
    part = [F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    return [F.lit(n << 32).bitwiseOR(F.shiftleft(part[a], 16)).bitwiseOR(part[b]) for n, (a, b) in enumerate(combinations(range(4), 2))]


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (fp, node), whole up to connection.

    Pairs in blocks of up to `block` members go through the pivot table and are verified; larger
    blocks are linked through the places at distance one.
    """
    dealt = checkpoint(distinct.select("fp", "node", *pivot_table(F.col("fp")), F.explode(F.array(*_blocks(F.col("fp")))).alias("key")))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = checkpoint(dealt.join(sizes, "key"))
    few = met.where(F.col("members") <= block)
    pairs = (
        few.alias("x")
        .join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))
        .where(largest_difference("x", "y") <= DISTANCE)
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= DISTANCE)
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    )
    crowd = met.where(F.col("members") > block).select("fp", "node").distinct()
    flips = F.array(*(F.lit(x) for x in [0, *(1 << k for k in range(63)), -(1 << 63)]))
    places = crowd.select("node", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("place"))
    hubs = places.groupBy("place").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("place", "a")
    close = places.join(hubs, "place").select("a", F.col("node").alias("b"))
    return pairs.union(close).where("a <> b").distinct()


def groups(every: DataFrame) -> DataFrame:
    """fp, its group (the smallest fingerprint that it reaches over links) and component_id (the group's smallest doc_id) of the fingerprints of rows (doc_id, fp)."""
    distinct = every.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reached = components(links(distinct.select("fp", F.col("fp").alias("node")))).withColumnRenamed("node", "fp")
    found = distinct.join(reached, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    return found.join(found.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "group", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    A null or empty text, or one of white space alone, has fingerprint zero and is linked like any
    other. Links are between fingerprints, so rows that share a doc_id share a group only if their
    texts do, and a row without an id links others; it takes the smallest id of its group, null if
    none has an id. A text of any length has one fingerprint. An empty table gives no rows; other
    columns are ignored.
    """
    every = checkpoint(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")))
    return every.join(groups(every), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest doc_id, and of several the one of the smallest hash of id and text.

    A row without an id stays only where its whole group has none. Rows are told apart by two 64-bit
    hashes of id and text, not by their id; of rows alike in both one stays.
    """
    key = F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id")
    every = checkpoint(docs.select("doc_id", key[0].alias("row"), key[1].alias("check"), fingerprint(F.col("text"), shingle).alias("fp")))
    first = every.join(groups(every), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    fresh = "_".join(docs.columns)  # longer than any column's name
    names = f"{fresh}_row", f"{fresh}_check"
    kept = first.groupBy("group").agg(F.min(F.struct("row", "check")).alias("k")).select(F.col("k.row").alias(names[0]), F.col("k.check").alias(names[1]))
    return docs.withColumns(dict(zip(names, key))).join(kept, list(names), "left_semi").dropDuplicates(list(names)).select(*docs.columns)
