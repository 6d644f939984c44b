"""Queries over whole tables, beside those whose SQL filters."""

from pyspark.sql import functions as F

from calorant.plans import driver_queries  # noqa: F401
from calorant.plans.analogues import read
from calorant.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_customer_has_its_range(spark):
    got = QUERIES["q09_whole_range_join"](spark, SF)
    assert got.select("range_id").distinct().count() == read(spark, SF, "customer").count()


def test_every_line_is_summed_and_both_gates_show(spark):
    got = QUERIES["q12_whole_summary_gates"](spark, SF).cache()
    assert got.agg(F.sum("expected")).first()[0] == read(spark, SF, "lineitem").count()
    assert {r.sla_status for r in got.select("sla_status").distinct().collect()} >= {"final", "provisional"}
    assert got.where("net_gbp is null").count() and got.where("net_gbp is not null").count()
