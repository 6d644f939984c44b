"""Idempotent loading of immutable facts, reconciliation of counts, and run coverage."""

from __future__ import annotations

import io

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from calorant.plans.folders import settled
from calorant.sources.objects import ImmutableConflict, put_if_absent

IDENTITY, PAYLOAD = "pipeline_identity_sha256", "pipeline_payload_sha256"
#: Folders of the store, by this many hexadecimal digits of the identity's hash.
DIGITS = 2
#: Identities that a scan of the store is told of, to skip row groups by their bloom filters.
LISTED = 1_000
#: Runs that are published in one call.
RUNS = 1_000


class LoadConflict(RuntimeError):
    """Rows whose identity is stored with another payload. Nothing was written. detail: identity, incoming and stored hashes of some."""

    def __init__(self, message: str, detail: list[tuple] = ()) -> None:
        super().__init__(message)
        self.detail = list(detail)


def bucket(digits: int) -> Column:
    return F.concat(F.lit("b"), F.substring(IDENTITY, 1, digits))


def packed(c: str) -> Column:
    """A text as bytes: 32 of a SHA-256 in hexadecimal, of any other text more."""
    return F.when(F.col(c).rlike(r"^[0-9a-f]{64}\z"), F.unhex(c)).otherwise(F.concat(F.lit("=" * 33), F.col(c)).cast("binary"))


def unpacked(c: str) -> Column:
    return F.when(F.length(c) == 32, F.lower(F.hex(c))).otherwise(F.substring(c, 34, 1 << 30).cast("string"))


def held(spark: SparkSession, path: str, like: DataFrame, incoming: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Rows of the store in the folders of the incoming identities; of few identities, in the row groups that may have them."""
    try:
        rows = spark.read.schema(StructType([f for f in like.schema if f.name != "_bucket"]).add("_bucket", "string")).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)
    folders = [r[0] for r in incoming.select(bucket(digits)).distinct().collect()]  # 16 ** digits at most
    rows = rows.where(F.col("_bucket").isin(folders)).drop("_bucket")
    few = [r[0] for r in incoming.select(IDENTITY).limit(LISTED + 1).collect()]
    return rows.where(F.col(IDENTITY).isin(few)) if len(few) <= LISTED else rows


def load(incoming: DataFrame, path: str, most_detail: int = 20, digits: int = DIGITS) -> dict[str, int]:
    """Append what is new, count replays, refuse on a conflict. Running it again changes nothing.

    Repeated identities within the incoming rows are one row if their payloads agree. The store has a
    folder for each beginning (`digits`, the same for all loads) of the identities' hashes, and bloom
    filters of them, so that a small load reads few files of a large store.
    """
    spark, names = incoming.sparkSession, incoming.columns
    others = [c for c in names if c not in (IDENTITY, PAYLOAD)]
    # hashes are dealt out and written as bytes, at half their size
    rows = settled(incoming.select(packed(IDENTITY).alias("_id"), packed(PAYLOAD).alias("_payload"), *others), "incoming")
    plain = lambda df: df.withColumns({IDENTITY: unpacked("_id"), PAYLOAD: unpacked("_payload")}).select(*names)
    once = rows.repartition("_id").groupBy("_id").agg(F.min("_payload").alias("_payload"), F.max("_payload").alias("_high"), F.first(F.struct(*others) if others else F.lit(0)).alias("_row"))
    stored = held(spark, path, incoming, plain(rows), digits).select(packed(IDENTITY).alias("_id"), packed(PAYLOAD).alias("_payload")).repartition("_id").groupBy("_id").agg(F.min("_payload").alias("_held"), F.count("*").alias("_times"))
    kind = F.when(F.col("_held").isNull(), "new").when(F.col("_held") == F.col("_payload"), "replay").otherwise("conflict")
    classed = once.join(stored, "_id", "left").withColumns({"load_class": kind, "_within": F.coalesce(F.col("_payload") != F.col("_high"), F.lit(False)), "_twice": F.coalesce(F.col("_times") > 1, F.lit(False))})
    # of replays only their number is kept
    told = (F.col("load_class") != "replay") | F.col("_within")
    classed = settled(classed.select("load_class", "_within", "_twice", *(F.when(told, F.col(c)).alias(c) for c in ("_id", "_payload", "_high", "_held")), F.when(F.col("load_class") == "new", F.col("_row")).alias("_row")), "load")
    within = classed.where("_within").select(unpacked("_id"), unpacked("_payload"), unpacked("_high"))
    clash = [tuple(r) for r in within.union(classed.where("load_class = 'conflict'").select(unpacked("_id"), unpacked("_payload"), unpacked("_held"))).limit(most_detail).collect()]
    if clash:
        raise LoadConflict("another payload: " + ", ".join(f"{i} has {a} and {b}" for i, a, b in clash), clash)
    classes = classed.groupBy("load_class").agg(F.count("*").alias("n"), F.count_if("_twice").alias("twice")).collect()
    counts, wrong = {r.load_class: r.n for r in classes}, sum(r.twice for r in classes)
    if counts.get("new"):
        fresh = classed.where("load_class = 'new'")
        fresh = fresh.select("_id", "_payload", *(F.col("_row")[c].alias(c) for c in others))
        new = plain(fresh)
        dealt = fresh.withColumn("_bucket", F.concat(F.lit("b"), F.substring(unpacked("_id"), 1, digits))).repartition("_bucket")
        dealt.select(unpacked("_id").alias(IDENTITY), unpacked("_payload").alias(PAYLOAD), *others, "_bucket").select(*names, "_bucket").write.mode("append").partitionBy("_bucket").option(f"parquet.bloom.filter.enabled#{IDENTITY}", "true").parquet(path)
        times = held(spark, path, incoming, new, digits).select(packed(IDENTITY).alias("_id")).repartition("_id").groupBy("_id").agg(F.count("*").alias("times"))
        wrong += fresh.select("_id").join(times, "_id", "left").where("times is null or times > 1").limit(1).count()
    if wrong:
        raise RuntimeError("a row that was to be loaded isn't there, or is there twice")
    return {"inserted": counts.get("new", 0), "reused": counts.get("replay", 0)}


def publish_coverage(runs: DataFrame, path: str, run: str, apart: tuple[str, ...] = ("published_at_utc",)) -> dict[str, int]:
    """A file of one row a run, with a hash of its content; a replay is reused, changed content is a LoadConflict.

    The content is all columns but those `apart`, as JSON in the order of their names, nulls included.
    A run's file has the run's name and is made once, so of writers at the same time one inserts it, and
    the others reuse it or conflict. Runs are control rows: up to RUNS a call.
    """
    spark = runs.sparkSession
    content = F.to_json(F.struct(*sorted(c for c in runs.columns if c not in apart)), {"ignoreNullFields": "false"})
    identity = F.sha2(F.concat(F.lit("run::"), F.col(run).cast("string")), 256)
    rows = runs.withColumns({IDENTITY: identity, PAYLOAD: F.sha2(content, 256)}).limit(RUNS + 1).toArrow()
    if rows.num_rows > RUNS:
        raise ValueError(f"up to {RUNS} runs are published at once")
    counts = {"inserted": 0, "reused": 0}
    for k in range(rows.num_rows):
        one = rows.slice(k, 1)
        name, payload = (one.column(c)[0].as_py() for c in (IDENTITY, PAYLOAD))
        out = io.BytesIO()
        pq.write_table(one, out)
        held_same = lambda b, own=payload: pq.read_table(io.BytesIO(b), columns=[PAYLOAD]).column(0)[0].as_py() == own
        try:
            made = put_if_absent(spark, f"{path}/{name}.parquet", out.getvalue(), held_same)
        except ImmutableConflict as e:
            raise LoadConflict(f"run {one.column(run)[0].as_py()} is published with other content", [(name, payload, None)]) from e
        counts["inserted" if made == "created" else "reused"] += 1
    return counts


def reconciliation(rows: DataFrame) -> DataFrame:
    """One row of counts by outcome (accepted, quarantined, replay), and whether they add up to all."""
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    total = rows.agg(F.count("*").alias("raw"), count("accepted").alias("accepted"), count("quarantined").alias("quarantined"), count("replay").alias("duplicates"))
    return total.withColumn("reconciled", F.col("raw") == F.col("accepted") + F.col("quarantined") + F.col("duplicates"))
