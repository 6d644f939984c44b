"""The contracts of the nine feeds: their fields, the values allowed, and rules between fields.

A rule is SQL over a row's typed fields that holds where the contract is broken. `_token_<name>` has the
field's token, for rules on whether a field is there at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from calorant.sources.jsonlines import is_integral, is_number, text_of

#: The patterns of text kinds, and their Spark types.
PATTERNS = {
    "id": r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$",
    "short": r"(?s)^.{1,256}$",
    "reason": r"(?s)^.{1,1024}$",
    "area": r"^[A-Z0-9 ]+$",
    "time": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?Z$",
    "half_hour": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):(?:00|30):00Z$",
    "quantity": r"^(?:0|[1-9][0-9]{0,13})\.[0-9]{6}$",
    "positive": r"^(?!0\.000000$)(?:0|[1-9][0-9]{0,13})\.[0-9]{6}$",
    "rate": r"^(?:0|[1-9][0-9]{0,11})\.[0-9]{6}$",
}
TYPES = {"time": "timestamp_ntz", "half_hour": "timestamp_ntz", "quantity": "decimal(20,6)", "positive": "decimal(20,6)", "rate": "decimal(18,6)", "whole": "bigint", "flag": "boolean", "real": "double"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    #: Whether the field may be left out; whether it may be null; the values allowed, if they are listed.
    optional: bool = False
    nullable: bool = False
    values: tuple = ()

    @property
    def token(self) -> Column:
        """The field's token, null where it is absent; of one reading of the object."""
        return F.col(f"_token_{self.name}")

    @property
    def text(self) -> Column:
        return F.col(f"_text_{self.name}")

    def texts(self) -> dict[str, Column]:
        """The text of a field that takes one."""
        return {} if self.kind in ("whole", "flag", "real") else {f"_text_{self.name}": text_of(self.token)}

    def value(self) -> Column:
        """The typed value; null where it is absent, null or not of its kind."""
        kind = TYPES.get(self.kind, "string")
        if self.kind == "whole":
            return F.when(is_integral(self.token), F.coalesce(self.token.try_cast(kind), self.token.try_cast("double").try_cast(kind)))
        if self.kind in ("flag", "real"):
            fits = self.token.isin("true", "false") if self.kind == "flag" else is_number(self.token)
            return F.when(fits, self.token.try_cast(kind))
        if kind == "timestamp_ntz":
            return F.rtrim(self.text, F.lit("Z")).try_cast(kind)
        return self.text if kind == "string" else self.text.try_cast(kind)

    def broken(self) -> Column:
        """Whether the field breaks its own rules. The typed value is there already."""
        if self.kind == "whole":
            fits = F.col(self.name) >= 1
        elif self.kind in ("flag", "real"):
            fits = F.col(self.name).isNotNull()
        else:
            fits = self.text.isin(*self.values) if self.values else self.text.rlike(PATTERNS[self.kind])
            if self.kind in ("time", "half_hour"):
                fits = fits & F.col(self.name).isNotNull()
        return F.when(self.token.isNull(), F.lit(not self.optional)).when(self.token == "null", F.lit(not self.nullable)).otherwise(~F.coalesce(fits, F.lit(False)))


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    rules: dict[str, str]
    #: The logical key of a revision, and the field that repeats it as an opaque id, if any.
    episode: tuple[str, ...]
    opaque: str | None = None
    #: SQL that holds for a row in force.
    active: str = "true"


def _one(name: str, *values: str) -> Field:
    return Field(name, "id", values=values)


def _any(name: str, kind: str) -> Field:
    return Field(name, kind, optional=True)


def _there(*names: str) -> str:
    return " or ".join(f"_token_{n} is not null" for n in names)


def _missing(*names: str) -> str:
    return " or ".join(f"{n} is null" for n in names)


STAMPS = ("approved_at_utc", "approved_by")
PERIOD = (Field("effective_from_utc", "time"), Field("effective_to_utc", "time", nullable=True))
INTERVAL = (Field("interval_start_utc", "half_hour"), Field("interval_end_utc", "half_hour"))
POINT, CUSTOMER, TERMS = Field("delivery_point_natural_id", "id"), Field("customer_natural_id", "id"), Field("contract_natural_id", "id")
CORRECTIONS = {"correction", "cancellation", "withdrawal", "reconciliation", "retroactive_amendment", "retroactive_change"}


def _contract(feed: str, revisions: str, fields: tuple, rules: dict[str, str], correction=("corrected_at_utc", "correction_reason_code", "correction_note"), **more) -> Contract:
    kinds = tuple(revisions.split())
    at, why, note = correction
    shared = (
        _one("source_schema_id", feed), _one("source_schema_version", "1.0.0"), Field("source_system_id", "id"), Field("synthetic_data", "flag"), Field("source_revision", "whole"),
        _one("revision_type", *kinds), Field("published_at_utc", "time"), _one("approval_state", "pending", "approved", "rejected", "withdrawn"), _any("approved_at_utc", "time"), _any("approved_by", "id"),
        _any("supersedes_source_revision", "whole"), _any(at, "time"), _any(why, "id"), _any(note, "reason"),
    )
    own = ", ".join(f"'{k}'" for k in kinds if k in CORRECTIONS)
    general = {"synthetic": "not synthetic_data"}
    if feed != "approved_excess_order":
        general["approval"] = f"approval_state = 'approved' and ({_missing(*STAMPS)})"
    if own:
        general["correction"] = f"revision_type in ({own}) and ({_missing('supersedes_source_revision', at, why, *STAMPS)} or approval_state <> 'approved')"
    return Contract((*shared, *fields), general | rules, **more)


def _cancelled(status: str, kind: str = "cancellation", value: str = "cancelled") -> dict[str, str]:
    return {"status": f"(revision_type = '{kind}') <> ({status} = '{value}')"}


_UNITS = "register_type = 'thermal_energy' and native_unit not in ('MWh_th', 'kWh_th', 'GJ_th') or register_type = 'steam_mass' and native_unit <> 't'"
_OBLIGATION = ("obligation_status", "committed_mwh_th", "quantity_unit", "commitment_reason_code")
_CAPACITIES = ("nameplate_ceiling_mwh_th", "operational_restriction_mwh_th", "deliverable_capacity_mwh_th")

#: Names, kinds and allowed values of the feeds' fields.
CONTRACTS = {
    "customer_master": _contract(
        "customer_master", "original business_change correction deactivation cancellation",
        (CUSTOMER, Field("customer_version_id", "id"), Field("legal_name", "short"), Field("display_name", "short"), _one("industry_sector_code", "cement", "ceramics", "chemicals", "food_and_beverage", "metals", "paper_and_pulp", "other_industrial"),
         _one("country_code", "GB"), _one("lifecycle_status", "active", "inactive"), Field("tenant_authorization_scope_id", "id"), *PERIOD, _one("version_record_status", "active", "cancelled")),
        _cancelled("version_record_status") | {"deactivation": "revision_type = 'deactivation' and lifecycle_status <> 'inactive'"}, episode=("customer_version_id",), active="version_record_status = 'active'",
    ),
    "industrial_site_master": _contract(
        "industrial_site_master", "original business_change correction deactivation cancellation",
        (Field("site_natural_id", "id"), Field("site_version_id", "id"), Field("site_name", "short"), Field("locality", "short"), Field("postal_area", "area"), _one("country_code", "GB"), _one("region_code", "GB-ENG", "GB-NIR", "GB-SCT", "GB-WLS"),
         _one("iana_timezone", "Europe/London"), _one("operational_status", "planned", "operational", "inactive", "decommissioned"), Field("latitude", "real", True, True), Field("longitude", "real", True, True), *PERIOD, _one("version_record_status", "active", "cancelled")),
        _cancelled("version_record_status") | {"deactivation": "revision_type = 'deactivation' and operational_status not in ('inactive', 'decommissioned')", "place": "abs(latitude) > 90 or abs(longitude) > 180"},
        episode=("site_version_id",), active="version_record_status = 'active'",
    ),
    "delivery_point_assignment": _contract(
        "delivery_point_assignment", "original correction cancellation",
        (Field("delivery_point_assignment_id", "id"), POINT, Field("delivery_point_name", "short"), Field("site_natural_id", "id"), CUSTOMER, _one("service_type", "industrial_steam"),
         Field("effective_from_utc", "half_hour"), PERIOD[1], _one("assignment_status", "active", "cancelled")),
        _cancelled("assignment_status"), episode=("delivery_point_assignment_id",), active="assignment_status = 'active'",
    ),
    "revenue_meter_assignment": _contract(
        "revenue_meter_assignment", "original correction cancellation",
        (Field("meter_assignment_id", "id"), Field("meter_natural_id", "id"), Field("register_natural_id", "id"), POINT, _one("assignment_role", "authoritative_revenue", "supporting_evidence"), _one("register_type", "thermal_energy", "steam_mass"),
         _one("native_unit", "MWh_th", "kWh_th", "GJ_th", "t"), Field("calibration_id", "id"), Field("maximum_plausible_30_min_change", "positive"), *PERIOD, _one("assignment_status", "active", "cancelled")),
        _cancelled("assignment_status") | {"unit": _UNITS, "role": "assignment_role = 'authoritative_revenue' and register_type <> 'thermal_energy'"}, episode=("meter_assignment_id",), active="assignment_status = 'active'",
    ),
    "contract_terms": _contract(
        "contract_terms", "original amendment correction retroactive_amendment withdrawal",
        (TERMS, Field("contract_terms_version_id", "id"), POINT, CUSTOMER, *PERIOD, Field("energy_rate_gbp_per_mwh_th", "rate"), Field("sla_penalty_rate_gbp_per_mwh_th", "rate"), _one("currency_code", "GBP"),
         Field("rate_unit", "short", values=("GBP/MWh_th",)), _one("terms_status", "active", "withdrawn"), _any("agreement_reference", "short")),
        _cancelled("terms_status", "withdrawal", "withdrawn") | {"agreement": "revision_type = 'retroactive_amendment' and (agreement_reference is null or change_reason_code <> 'approved_retroactive_agreement')"},
        ("changed_at_utc", "change_reason_code", "change_note"), episode=("contract_terms_version_id",), active="terms_status = 'active'",
    ),
    "commitment_schedule": _contract(
        "commitment_schedule", "original change correction retroactive_change withdrawal",
        (Field("source_commitment_revision_id", "id"), POINT, CUSTOMER, TERMS, *INTERVAL, Field("obligation_status", "id", True, values=("committed", "no_commitment")), _any("committed_mwh_th", "quantity"), Field("quantity_unit", "id", True, values=("MWh_th",)),
         Field("commitment_reason_code", "id", True, values=("normal_operation", "approved_maintenance", "customer_shutdown", "other_approved_exclusion")), _one("schedule_record_status", "active", "withdrawn"), _any("approval_reference", "short")),
        _cancelled("schedule_record_status", "withdrawal", "withdrawn") | {
            "withdrawn": f"revision_type = 'withdrawal' and ({_there(*_OBLIGATION)})", "obligation": f"revision_type <> 'withdrawal' and ({_missing(*_OBLIGATION)})",
            "committed": "obligation_status = 'committed' and (committed_mwh_th <= 0 or commitment_reason_code <> 'normal_operation')",
            "excluded": "obligation_status = 'no_commitment' and (committed_mwh_th <> 0 or commitment_reason_code = 'normal_operation' or approval_reference is null)",
        }, episode=("delivery_point_natural_id", "interval_start_utc"), opaque="source_commitment_revision_id", active="schedule_record_status = 'active'",
    ),
    "approved_excess_order": _contract(
        "approved_excess_order", "original amendment correction cancellation",
        (Field("excess_order_natural_id", "id"), Field("order_interval_line_id", "id"), POINT, CUSTOMER, TERMS, *INTERVAL, Field("approved_extra_mwh_th", "quantity"), _one("quantity_unit", "MWh_th"),
         _one("order_state", "requested", "approved", "rejected", "cancelled"), Field("requested_at_utc", "time")),
        {"approved": f"order_state = 'approved' and (approved_extra_mwh_th <= 0 or approval_state <> 'approved' or {_missing(*STAMPS)})", "requested": "order_state = 'requested' and (approved_extra_mwh_th <= 0 or approval_state <> 'pending')",
         "rejected": "order_state = 'rejected' and approval_state <> 'rejected'", "cancelled": "revision_type = 'cancellation' and (order_state <> 'cancelled' or approved_extra_mwh_th <> 0 or approval_state <> 'approved')"},
        episode=("order_interval_line_id",),
    ),
    "revenue_meter_reading": _contract(
        "revenue_meter_reading", "original correction reconciliation withdrawal",
        (Field("source_reading_revision_id", "id"), Field("meter_natural_id", "id"), Field("register_natural_id", "id"), Field("reading_at_utc", "half_hour"), Field("register_type", "id", True, values=("thermal_energy", "steam_mass")), _any("cumulative_value", "quantity"),
         Field("native_unit", "id", True, values=("MWh_th", "kWh_th", "GJ_th", "t")), Field("reading_method", "id", True, values=("actual", "estimated", "substituted")), _one("reading_status", "active", "withdrawn")),
        _cancelled("reading_status", "withdrawal", "withdrawn") | {
            "withdrawn": f"revision_type = 'withdrawal' and ({_there('register_type', 'cumulative_value', 'native_unit', 'reading_method')})",
            "value": f"revision_type <> 'withdrawal' and ({_missing('register_type', 'cumulative_value', 'native_unit', 'reading_method')})", "unit": _UNITS,
        }, episode=("meter_natural_id", "register_natural_id", "reading_at_utc"), opaque="source_reading_revision_id", active="reading_status = 'active'",
    ),
    "delivery_point_capacity_assessment": _contract(
        "delivery_point_capacity_assessment", "original finalization correction withdrawal",
        (Field("source_capacity_revision_id", "id"), POINT, *INTERVAL, _one("assessment_status", "provisional", "final", "rejected", "withdrawn"), *(_any(c, "quantity") for c in _CAPACITIES), _one("quantity_unit", "MWh_th"),
         Field("assessment_method", "id"), Field("assessment_method_version", "id"), _one("capacity_reason_code", "normal", "derated", "planned_restriction", "unavailable"), _any("finalized_at_utc", "time")),
        {"quantities": f"assessment_status <> 'withdrawn' and ({_missing(*_CAPACITIES)})", "final": "assessment_status = 'final' and (finalized_at_utc is null or approval_state <> 'approved')",
         "finalization": "revision_type = 'finalization' and assessment_status <> 'final'", "withdrawn": f"revision_type = 'withdrawal' and (assessment_status <> 'withdrawn' or {_there(*_CAPACITIES, 'finalized_at_utc')})",
         "unavailable": "capacity_reason_code = 'unavailable' and deliverable_capacity_mwh_th <> 0"},
        episode=("delivery_point_natural_id", "interval_start_utc"), opaque="source_capacity_revision_id",
    ),
}
