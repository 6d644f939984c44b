"""Validation passes over a small world of lines in which single things are broken."""

from __future__ import annotations

import json

import pytest

from calorant.plans import validation

STAMP = {"published_at_utc": "2026-08-01T00:00:00Z", "approval_state": "approved", "approved_at_utc": "2026-08-01T00:00:00Z", "approved_by": "ops-1", "synthetic_data": True, "source_schema_version": "1.0.0", "source_system_id": "gen", "source_revision": 1, "revision_type": "original"}
PERIOD = {"effective_from_utc": "2026-01-01T00:00:00Z", "effective_to_utc": None}
CELL = {"delivery_point_natural_id": "DP-1", "interval_start_utc": "2026-08-26T00:00:00Z", "interval_end_utc": "2026-08-26T00:30:00Z"}
WHO = {"customer_natural_id": "CUST-1", "contract_natural_id": "CON-1"}


def world():
    """One valid row of each feed, two readings."""
    rows = {
        "customer_master": [{"customer_natural_id": "CUST-1", "customer_version_id": "CV-1", "legal_name": "L", "display_name": "D", "industry_sector_code": "metals", "country_code": "GB", "lifecycle_status": "active", "tenant_authorization_scope_id": "T-1", "version_record_status": "active", **PERIOD}],
        "industrial_site_master": [{"site_natural_id": "SITE-1", "site_version_id": "SV-1", "site_name": "S", "locality": "Leeds", "postal_area": "LS", "country_code": "GB", "region_code": "GB-ENG", "iana_timezone": "Europe/London", "operational_status": "operational", "latitude": 53.8, "longitude": None, "version_record_status": "active", **PERIOD}],
        "delivery_point_assignment": [{"delivery_point_assignment_id": "DPA-1", "delivery_point_natural_id": "DP-1", "delivery_point_name": "P", "site_natural_id": "SITE-1", "customer_natural_id": "CUST-1", "service_type": "industrial_steam", "assignment_status": "active", **PERIOD}],
        "revenue_meter_assignment": [{"meter_assignment_id": "MA-1", "meter_natural_id": "RM-1", "register_natural_id": "E-1", "delivery_point_natural_id": "DP-1", "assignment_role": "authoritative_revenue", "register_type": "thermal_energy", "native_unit": "MWh_th", "calibration_id": "CAL-1", "maximum_plausible_30_min_change": "8.000000", "assignment_status": "active", **PERIOD}],
        "contract_terms": [{"contract_natural_id": "CON-1", "contract_terms_version_id": "CT-1", "delivery_point_natural_id": "DP-1", "customer_natural_id": "CUST-1", "energy_rate_gbp_per_mwh_th": "50.000000", "sla_penalty_rate_gbp_per_mwh_th": "100.000000", "currency_code": "GBP", "rate_unit": "GBP/MWh_th", "terms_status": "active", **PERIOD}],
        "commitment_schedule": [{"source_commitment_revision_id": "COM-1", "obligation_status": "committed", "committed_mwh_th": "5.000000", "quantity_unit": "MWh_th", "commitment_reason_code": "normal_operation", "schedule_record_status": "active", **CELL, **WHO}],
        "approved_excess_order": [{"excess_order_natural_id": "EO-1", "order_interval_line_id": "EOL-1", "approved_extra_mwh_th": "0.400000", "quantity_unit": "MWh_th", "order_state": "approved", "requested_at_utc": "2026-08-01T00:00:00Z", **CELL, **WHO}],
        "revenue_meter_reading": [{"source_reading_revision_id": f"RR-{k}", "meter_natural_id": "RM-1", "register_natural_id": "E-1", "reading_at_utc": f"2026-08-26T00:{k}0:00Z", "register_type": "thermal_energy", "cumulative_value": f"100{k}.000000", "native_unit": "MWh_th", "reading_method": "actual", "reading_status": "active"} for k in (0, 3)],
        "delivery_point_capacity_assessment": [{"source_capacity_revision_id": "CAP-1", "assessment_status": "final", "nameplate_ceiling_mwh_th": "7.000000", "operational_restriction_mwh_th": "0.500000", "deliverable_capacity_mwh_th": "6.500000", "quantity_unit": "MWh_th", "assessment_method": "m", "assessment_method_version": "1", "capacity_reason_code": "normal", "finalized_at_utc": "2026-08-01T00:00:00Z", **CELL}],
    }
    return {feed: [{"source_schema_id": feed} | STAMP | r for r in own] for feed, own in rows.items()}


def run(spark, rows, raw=None):
    """Outcomes and issues by feed, in the order of lines; raw replaces or adds lines of a feed."""
    lines = {feed: [json.dumps(r) for r in own] for feed, own in rows.items()}
    for feed, extra in (raw or {}).items():
        lines[feed] += extra
    frames = {feed: spark.createDataFrame([(f"{i:04d}", x) for i, x in enumerate(own)], "locator string, line string") for feed, own in lines.items() if own}
    got = validation.validate(frames)
    return got, {feed: [(r.outcome, sorted(r.issues)) for r in df.orderBy("locator").collect()] for feed, df in got.items()}


OK = ("accepted", [])


def test_a_valid_world_is_accepted(spark, tmp_path):
    feeds, got = run(spark, world())
    assert {f: set(map(str, o)) for f, o in got.items()} == {f: {str(OK)} for f in got}
    taken = validation.accepted(feeds)
    first = taken["commitment_schedule"].first()
    assert str(first.committed_mwh_th) == "5.000000" and len(first.pipeline_identity_sha256) == 64
    validation.write_outcomes(feeds, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/report").agg({"rows": "sum"}).first()[0] == 10


def test_single_faults(spark):
    """Many independent faults in one bundle, each in rows of its own."""
    w = world()
    extra = lambda feed, **change: {k: v for k, v in (w[feed][0] | change).items() if v != "-"}
    later = {"interval_start_utc": "2026-08-26T05:00:00Z", "interval_end_utc": "2026-08-26T05:30:00Z"}
    w["commitment_schedule"] += [
        extra("commitment_schedule"),
        extra("commitment_schedule", source_commitment_revision_id="COM-2", **later, customer_natural_id="CUST-9"),
        extra("commitment_schedule", source_commitment_revision_id="COM-3", interval_start_utc="2026-08-26T06:00:00Z", interval_end_utc="2026-08-26T07:00:00Z"),
        extra("commitment_schedule", source_commitment_revision_id="COM-4", source_revision=0),
        extra("commitment_schedule", source_commitment_revision_id="COM-5", interval_start_utc="2026-08-26T08:00:00Z", interval_end_utc="2026-08-26T08:30:00Z", committed_mwh_th="0.000000"),
        extra("commitment_schedule", source_commitment_revision_id="COM-6", interval_start_utc="2025-08-26T08:00:00Z", interval_end_utc="2025-08-26T08:30:00Z"),
        extra("commitment_schedule", source_commitment_revision_id="COM-7", surprise=1),
        extra("commitment_schedule", source_commitment_revision_id="COM-8", approved_by="-"),
    ]
    w["revenue_meter_reading"] += [
        extra("revenue_meter_reading", source_reading_revision_id="RR-8", reading_at_utc="2026-08-26T09:00:00Z", native_unit="kWh_th"),
        extra("revenue_meter_reading", source_reading_revision_id="RR-9", reading_at_utc="2026-08-26T10:00:00Z", cumulative_value="7.000000"),
        extra("revenue_meter_reading", source_reading_revision_id="RR-9", reading_at_utc="2026-08-26T10:00:00Z", cumulative_value="8.000000"),
        extra("revenue_meter_reading", source_reading_revision_id="RR-0", reading_at_utc="2026-08-26T11:00:00Z"),
    ]
    w["delivery_point_capacity_assessment"] += [extra("delivery_point_capacity_assessment", source_capacity_revision_id="CAP-2", **later, deliverable_capacity_mwh_th="6.000000")]
    w["approved_excess_order"] += [extra("approved_excess_order", order_interval_line_id="EOL-2", interval_start_utc="2026-08-26T12:00:00Z", interval_end_utc="2026-08-26T12:30:00Z")]
    raw = {"customer_master": ["", '{"a": 1, "a": 2}', '{"a": NaN}', "[1]"]}
    _, got = run(spark, w, raw)
    q = lambda *codes: ("quarantined", list(codes))
    assert got["customer_master"] == [OK, q("empty_jsonl_line"), q("duplicate_json_key"), q("invalid_json"), q("record_not_object")]
    bad = q("schema_validation_failed")
    assert got["commitment_schedule"] == [
        OK, ("replay", []), q("assignment_customer_mismatch", "contract_customer_mismatch"), q("interval_not_30_minutes"), bad, bad,
        q("delivery_point_assignment_coverage_missing"), bad, bad,
    ]
    clash = q("source_revision_conflict")
    assert got["revenue_meter_reading"] == [q("opaque_revision_id_reused"), OK, q("meter_register_metadata_mismatch"), clash, clash, q("opaque_revision_id_reused")]
    assert got["delivery_point_capacity_assessment"] == [OK, q("capacity_arithmetic_mismatch")]
    assert got["approved_excess_order"] == [OK, q("positive_commitment_missing")]


def test_faults_of_parents_reach_children(spark):
    w = world()
    w["contract_terms"] += [w["contract_terms"][0] | {"contract_terms_version_id": "CT-2"}]
    w["delivery_point_assignment"] += [w["delivery_point_assignment"][0] | {"delivery_point_assignment_id": "DPA-2", "delivery_point_natural_id": "DP-2", "customer_natural_id": "CUST-7"}]
    w["revenue_meter_assignment"] += [w["revenue_meter_assignment"][0] | {"meter_assignment_id": "MA-2", "meter_natural_id": "RM-2", "delivery_point_natural_id": "DP-2"}]
    _, got = run(spark, w)
    assert got["contract_terms"] == [("quarantined", ["contract_terms_overlap"])] * 2
    assert got["commitment_schedule"] == [("quarantined", ["contract_effective_coverage_missing"])]
    assert got["delivery_point_assignment"] == [OK, ("quarantined", ["customer_reference_missing"])]
    assert got["revenue_meter_assignment"] == [OK, ("quarantined", ["delivery_point_reference_missing"])]


def test_unknown_feeds_raise(spark):
    with pytest.raises(ValueError, match="unsupported_dataset"):
        validation.validate({"other": spark.createDataFrame([], "locator string, line string")})
