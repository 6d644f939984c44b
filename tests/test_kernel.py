"""The calculation kernel against hand-computed scenarios, and units, keys and calendar."""

from __future__ import annotations

import hashlib
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from calorant.functions.calendar import half_hours
from calorant.functions.keys import state_fingerprint, surrogate_key
from calorant.functions.measures import REVISIONS, delivery_status, interval_results, percent, to_mwh
from calorant.plans.product import summary

SCENARIOS = {
    "16": ([("5", "5.2", "5.5"), ("5", "4.8", "4.8")], ("10", "0.2", "0.2", "9.8"), ("98", "98"), ("490", "20", "470")),
    "17 initial": ([("5", "5", "5"), ("5", None, "5")], ("5", "0", "0", "5"), (None, "100"), ("250", None, None)),
    "17 reconciled": ([("5", "5", "5"), ("5", "4.5", "5")], ("9.5", "0.5", "0", "9.5"), ("95", "100"), ("475", "50", "425")),
    "18 original": ([("5", "4.7", "5"), ("5", "5.3", "5")], ("10", "0.3", "0.3", "9.7"), ("97", "100"), ("485", "30", "455")),
    "18 corrected": ([("5", "4.9", "5"), ("5", "5.1", "5")], ("10", "0.1", "0.1", "9.9"), ("99", "100"), ("495", "10", "485")),
}


def inputs(spark, rows):
    """Interval inputs from (scenario, committed, delivered, capacity); finite contract, no order, revisions 1."""
    df = spark.createDataFrame(rows, "scenario string, c string, d string, cap string")
    mwh = lambda c: F.col(c).cast("decimal(20,6)")
    one = {f"{r}_revision": F.lit(1) for r in REVISIONS}
    return df.withColumns(one | {
        "committed_mwh": mwh("c"), "delivered_mwh": mwh("d"), "capacity_mwh": mwh("cap"), "commitment_revision": F.when(F.col("c").isNotNull(), 1), "schedule_status": F.lit("active"),
        "obligation_status": F.when(mwh("c") == 0, "no_commitment").otherwise("committed"), "delivery_status": F.when(F.col("d").isNull(), "boundary_missing").otherwise("accepted"),
        "order_count": F.lit(None).cast("int"), "order_state": F.lit(None).cast("string"), "order_mwh": F.lit(None).cast("decimal(20,6)"), "customer_version_id": F.lit("c"), "site_version_id": F.lit("s"),
        "contract_terms_version_id": F.lit("t"), "energy_rate": F.lit(50).cast("decimal(18,6)"), "penalty_rate": F.lit(100).cast("decimal(18,6)"), "capacity_status": F.when(F.col("cap").isNotNull(), "final"),
    })


@pytest.fixture(scope="module")
def totals(spark):
    rows = [(k, *x) for k, (intervals, *_) in SCENARIOS.items() for x in intervals]
    return {r.scenario: r for r in summary(interval_results(inputs(spark, rows)), ["scenario"]).collect()}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(totals, name):
    _, energy, shares, money = SCENARIOS[name]
    r, n = totals[name], lambda xs: tuple(None if x is None else D(x) for x in xs)
    assert (r.delivered_mwh, r.shortfall_mwh, r.excess_mwh, r.billable_mwh) == n(energy)
    assert (r.sla_percent, r.availability_percent) == n(shares)
    assert (r.gross_gbp, r.penalty_gbp, r.net_gbp) == n(money)


def test_statuses_and_nulls(spark):
    rows = [("none", "0", "0", None), ("missing", None, "4.9", "6"), ("open", "5", None, None)]
    got = {r.scenario: r for r in interval_results(inputs(spark, rows)).collect()}
    assert (got["none"].sla_status, got["none"].availability_status, got["none"].financial_status) == ("not_applicable", "not_applicable", "final")
    assert got["missing"].commitment_status == "missing" and got["missing"].billable_mwh is None and got["missing"].applicable_count is None
    assert (got["open"].sla_status, got["open"].shortfall_mwh, got["open"].net_gbp) == ("provisional", None, None)


@pytest.mark.parametrize(("count", "state", "want"), [(None, None, "0"), (1, "approved", "0.5"), (1, "cancelled", "0"), (2, "approved", None), (1, "requested", None), (1, "rejected", None)])
def test_approved_extra(spark, count, state, want):
    df = inputs(spark, [("x", "5", "6", "7")]).withColumns({"order_count": F.lit(count).cast("int"), "order_state": F.lit(state).cast("string"), "order_mwh": F.lit("0.5").cast("decimal(20,6)")})
    assert interval_results(df).first().approved_extra_mwh == (None if want is None else D(want))


def test_correction_flag(spark):
    df = inputs(spark, [("x", "5", "6", "7")])
    assert [interval_results(df.withColumn(f"{r}_revision", F.lit(2))).first().corrected for r in REVISIONS] == [True] * len(REVISIONS)
    assert not interval_results(df.withColumn("order_revision", F.lit(None).cast("int"))).first().corrected


def test_summary_of_no_rows(spark):
    r = summary(interval_results(inputs(spark, [("x", "5", "5", "5")])).where("false")).first()
    assert (r.sla_status, r.availability_status, r.financial_status, r.sla_percent, r.net_gbp) == ("no_data", "no_data", "no_data", None, None)


def test_units(spark):
    rows = [("3", "MWh_th"), ("3", "kWh_th"), ("3.6", "GJ_th"), ("3", "t"), (None, "MWh_th")]
    got = [r[0] for r in spark.createDataFrame(rows, "v string, u string").select(to_mwh(F.col("v"), F.col("u"))).collect()]
    assert got == [D("3"), D("0.003"), D("1"), None, None]


@pytest.mark.parametrize(
    ("changes", "want"),
    [
        ({}, "accepted"), ({"meter": None}, "meter_assignment_missing"), ({"o_id": None}, "boundary_missing"), ({"c_status": "withdrawn"}, "boundary_withdrawn"),
        ({"o_method": "estimated"}, "non_actual_reading"), ({"c_unit": "GJ_th"}, "unit_mismatch"), ({"c_value": "0"}, "negative_delta"), ({"c_value": "99"}, "implausible_delta"),
        ({"o_id": None, "c_value": "99"}, "boundary_missing"), ({"c_value": "9"}, "accepted"), ({"c_value": "1"}, "accepted"),
    ],
)
def test_delivery_status_ladder(spark, changes, want):
    row = {"meter": "m"} | {f"{e}_{k}": v for e, x in (("o", "1"), ("c", "6")) for k, v in (("id", "r"), ("status", "active"), ("method", "actual"), ("unit", "MWh_th"), ("value", x))} | changes
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    end = lambda e: {k: F.col(f"{e}_{k}").cast("decimal(20,6)") if k == "value" else F.col(f"{e}_{k}") for k in ("id", "status", "method", "unit", "value")}
    assert df.select(delivery_status(F.col("meter"), end("o"), end("c"), F.lit("MWh_th"), F.lit(8).cast("decimal(20,6)"))).first()[0] == want


def test_keys(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None)], "x string, y string")
    one, two, absent = (r[0] for r in df.select(surrogate_key("x", "y")).collect())
    assert one == hashlib.sha256(b"1:a|2:bc").hexdigest() and one != two and absent is None
    assert df.select(state_fingerprint("x", "y")).collect()[2][0] == hashlib.sha256(b"1:a|6:<null>").hexdigest()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_of_46_48_and_50_half_hours(spark, zone):
    days = [(date(2026, 3, 29),), (date(2026, 8, 26),), (date(2026, 10, 25),)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark.createDataFrame(days, "d date").select(F.size(half_hours(F.col("d"))), half_hours(F.col("d"))[0].cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [tuple(r) for r in got] == [(46, "2026-03-29 00:00:00"), (48, "2026-08-25 23:00:00"), (50, "2026-10-24 23:00:00")]


def test_percent_is_half_even(spark):
    rows = [("1", "3"), ("0.00000000", "1"), ("1", "0"), (None, "1")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(percent(F.col("a").cast("decimal(20,6)"), F.col("b").cast("decimal(20,6)"))).collect()]
    assert got == [D("33.333333"), D("0"), None, None]
