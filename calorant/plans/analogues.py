"""Inputs that stand in for feeds on the driver's tables, in Spark and in SQL.

Revision log: events under (user_id, event_type), revision and clock from props and ts. Interval
facts: lineitem as commitment, delivery and capacity. Effective versions: a customer's orders, each
from its date to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rev = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", rev.alias("rev"), F.col("value").cast("decimal(18,6)").alias("value"))


REVISION_LOG = "SELECT event_id, user_id, event_type, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS rev, CAST(value AS DECIMAL(18,6)) AS value FROM events"


def interval_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c, t: F.col(c).cast(t)
    q, tax, off = d("l_quantity", "decimal(10,2)"), d("l_tax", "decimal(6,4)"), d("l_discount", "decimal(6,4)")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate",
        F.when(F.col("l_linenumber") != 7, q.cast("decimal(20,6)")).alias("committed_mwh"),
        F.when(F.col("l_returnflag") != "N", (q * (1 + tax - off)).cast("decimal(20,6)")).alias("delivered_mwh"),
        F.when(F.col("l_linestatus") == "F", (q * (1 - off)).cast("decimal(20,6)")).alias("capacity_mwh"),
        d("l_extendedprice", "decimal(18,6)").alias("energy_rate"),
        (d("l_extendedprice", "decimal(16,6)") * 2).cast("decimal(18,6)").alias("penalty_rate"),
    )


INTERVAL_INPUTS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate,
 CASE WHEN l_linenumber <> 7 THEN CAST(q AS DECIMAL(20,6)) END AS committed_mwh,
 CASE WHEN l_returnflag <> 'N' THEN CAST(q * (1 + tax - off) AS DECIMAL(20,6)) END AS delivered_mwh,
 CASE WHEN l_linestatus = 'F' THEN CAST(q * (1 - off) AS DECIMAL(20,6)) END AS capacity_mwh,
 CAST(l_extendedprice AS DECIMAL(18,6)) AS energy_rate, CAST(CAST(l_extendedprice AS DECIMAL(16,6)) * 2 AS DECIMAL(18,6)) AS penalty_rate
 FROM (SELECT *, CAST(l_quantity AS DECIMAL(10,2)) AS q, CAST(l_tax AS DECIMAL(6,4)) AS tax, CAST(l_discount AS DECIMAL(6,4)) AS off FROM lineitem)"""


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderpriority", F.col("o_orderdate").alias("effective_from_utc"), F.lead("o_orderdate").over(w).alias("effective_to_utc")
    )


ORDER_VERSIONS = "SELECT o_custkey, o_orderkey, o_orderpriority, o_orderdate AS effective_from_utc, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS effective_to_utc FROM orders"
