"""Energy units and the calculation kernel of an interval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENERGY, RATE, MONEY = "decimal(20,6)", "decimal(18,6)", "decimal(38,12)"


def to_mwh(value: Column, unit: Column) -> Column:
    """Thermal energy in MWh; null for a unit that isn't energy."""
    value = value.cast(ENERGY)
    return (
        F.when(unit == "MWh_th", value)
        .when(unit == "kWh_th", value / F.lit(1000).cast("decimal(4,0)"))
        .when(unit == "GJ_th", value / F.lit("3.6").cast("decimal(2,1)"))
        .cast(ENERGY)
    )


def all_known(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])


def money(energy: Column, rate: Column) -> Column:
    """Exact product of an energy and a rate, whatever the session's decimal rules."""
    return (energy.cast(RATE) * rate.cast(RATE)).cast(MONEY)


def percent(part: Column, whole: Column) -> Column:
    """100 x part / whole, half-even to six places; null where the whole is null or 0."""
    return F.when(whole != 0, F.bround(100 * part.cast(ENERGY) / whole.cast(ENERGY), 6)).cast("decimal(20,6)")


#: Revisions that make an interval count as corrected when any is above 1.
REVISIONS = ["customer", "site", "assignment", "meter_assignment", "contract", "opening", "closing", "commitment", "order", "capacity"]


def interval_results(df: DataFrame) -> DataFrame:
    """All results of an interval from its inputs.

    Inputs: commitment_revision, schedule_status, obligation_status, committed_mwh; delivered_mwh,
    delivery_status; order_count, order_state, order_mwh; customer_version_id, site_version_id;
    contract_terms_version_id, energy_rate, penalty_rate; capacity_status, capacity_mwh; and
    <name>_revision for REVISIONS. A result is null wherever an input that it needs is.
    """
    zero = F.lit(0).cast(ENERGY)
    c, d, cap = F.col("committed_mwh"), F.col("delivered_mwh"), F.col("capacity_mwh")
    df = df.withColumns({
        "commitment_status": F.when(F.col("commitment_revision").isNull(), "missing").when(F.col("schedule_status") == "withdrawn", "withdrawn").otherwise(F.col("obligation_status")),
        "approved_extra_mwh": F.when(F.coalesce("order_count", F.lit(0)) == 0, zero).when((F.col("order_count") == 1) & (F.col("order_state") == "approved"), F.col("order_mwh")).when((F.col("order_count") == 1) & (F.col("order_state") == "cancelled"), zero).cast(ENERGY),
        "access_status": F.when(all_known(F.col("customer_version_id"), F.col("site_version_id")), "authorized").otherwise("unresolved"),
        "contract_status": F.when(F.col("contract_terms_version_id").isNotNull(), "accepted").otherwise("missing"),
    })
    extra, contract = F.col("approved_extra_mwh"), F.col("contract_status") == "accepted"
    both, all3 = all_known(c, d), all_known(c, d, extra)
    df = df.withColumns({
        "shortfall_mwh": F.when(both, F.greatest((c - d).cast(ENERGY), zero)),
        "excess_mwh": F.when(both, F.greatest((d - c).cast(ENERGY), zero)),
        "billable_mwh": F.when(all3 & contract, F.least(d, (c + extra).cast(ENERGY))),
        "unbilled_mwh": F.when(all3, F.greatest((d - c - extra).cast(ENERGY), zero)),
        "sla_numerator_mwh": F.when(c == 0, zero).when(both, F.least(d, c)),
        "availability_numerator_mwh": F.when(c == 0, zero).when(c.isNotNull() & (F.col("capacity_status") == "final") & cap.isNotNull(), F.least(cap, c)),
    })
    df = df.withColumns({
        "gross_gbp": F.when(all_known(F.col("billable_mwh"), F.col("energy_rate")), money(F.col("billable_mwh"), F.col("energy_rate"))),
        "penalty_gbp": F.when(all_known(F.col("shortfall_mwh"), F.col("penalty_rate")), money(F.col("shortfall_mwh"), F.col("penalty_rate"))),
        "expected_count": F.lit(1),
        "commitment_count": F.col("commitment_revision").isNotNull().cast("int"),
        "applicable_count": F.when(c > 0, 1).when(c == 0, 0),
        "accepted_count": F.when(c > 0, (F.col("delivery_status") == "accepted").cast("int")).when(c == 0, 0),
        "final_capacity_count": F.when(c > 0, (F.coalesce("capacity_status", F.lit("missing")) == "final").cast("int")).when(c == 0, 0),
    })
    unresolved = F.col("commitment_status").isin("missing", "withdrawn")
    open_delivery, open_capacity = F.col("delivery_status") != "accepted", F.coalesce("capacity_status", F.lit("missing")) != "final"
    status = lambda open_: F.when(F.col("commitment_status") == "no_commitment", "not_applicable").when(unresolved | open_, "provisional").otherwise("final")
    return df.withColumns({
        "net_gbp": F.when(all_known(F.col("gross_gbp"), F.col("penalty_gbp")), (F.col("gross_gbp") - F.col("penalty_gbp")).cast(MONEY)),
        "sla_status": status(open_delivery),
        "availability_status": status(open_capacity),
        "financial_status": F.when(unresolved | open_delivery | ~contract | extra.isNull(), "provisional").otherwise("final"),
        "corrected": reduce(lambda a, b: a | b, [F.coalesce(f"{r}_revision", F.lit(1)) > 1 for r in REVISIONS]),
    })


def delivery_status(meter_id: Column, opening: dict[str, Column], closing: dict[str, Column], unit: Column, most: Column) -> Column:
    """Status of a register delta by the first rule that applies.

    opening, closing: id, status, method, unit and value of the readings at both ends.
    """
    either = lambda rule: rule(opening) | rule(closing)
    delta = (closing["value"] - opening["value"]).cast(ENERGY)
    return (
        F.when(meter_id.isNull(), "meter_assignment_missing")
        .when(either(lambda r: r["id"].isNull()), "boundary_missing")
        .when(either(lambda r: r["status"] == "withdrawn"), "boundary_withdrawn")
        .when(either(lambda r: r["method"] != "actual"), "non_actual_reading")
        .when(either(lambda r: r["unit"] != unit), "unit_mismatch")
        .when(delta < 0, "negative_delta")
        .when(delta > most, "implausible_delta")
        .otherwise("accepted")
    )
