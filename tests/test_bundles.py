"""Bundles of files, codes of the schema and row passes, published files, and percent-encoding."""

from __future__ import annotations

import json
import urllib.parse

from pyspark.sql import functions as F

from calorant.functions.keys import percent_encoded
from calorant.operators import relations
from calorant.plans import validation
from calorant.sources.contracts import CONTRACTS
from calorant.streaming.windows import counted_windows, drained

CUSTOMER = "customer_master"


def lines(spark, *texts):
    return spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(texts)], "locator string, line string")


def test_missing_feeds_are_told_apart(spark, tmp_path):
    (tmp_path / f"{CUSTOMER}.jsonl").write_text("[1]\n")
    (tmp_path / "contract_terms.jsonl").write_text("")
    given, issues = validation.read_bundle(spark, str(tmp_path))
    assert set(given) == {CUSTOMER, "contract_terms"} and given["contract_terms"].count() == 0
    assert {tuple(r) for r in issues.collect()} == {(f, "dataset_file_missing") for f in CONTRACTS if f not in given}
    given, issues = validation.read_bundle(spark, str(tmp_path), {CUSTOMER: f"{CUSTOMER}.jsonl", "other": "x"})
    assert set(given) == {CUSTOMER}
    assert {tuple(r) for r in issues.collect()} == {("other", "unsupported_dataset")} | {(f, "dataset_missing") for f in CONTRACTS if f != CUSTOMER}


def test_payloads_and_identities(spark):
    contract = CONTRACTS[CUSTOMER]
    key = {"source_system_id": "a b/ü*~", "customer_version_id": "C:1", "source_revision": 1}
    texts = ['{"b": {"z": 1, "a": [{"y": 1, "x": 2}]}, "a": null}', '{"a":null,"b":{"a":[{"x":2,"y":1}],"z":1}}', '{"a": 1e400}', json.dumps(key)]
    rows = validation.parsed(lines(spark, *texts), CUSTOMER, contract).orderBy("locator").collect()
    assert rows[0].payload_sha256 == rows[1].payload_sha256 is not None
    assert rows[2].payload_sha256 is None and "payload_not_canonical_json" in rows[2].issues
    assert rows[3].identity == "::".join([CUSTOMER, *(f"{k}={urllib.parse.quote(str(v), safe='-._~')}" for k, v in key.items())])


def test_an_identity_without_its_fields(spark):
    """A contract that asks for nothing leaves the identity to be missed."""
    loose = type(CONTRACTS[CUSTOMER])(fields=(), rules={}, episode=("customer_version_id",))
    row = validation.parsed(lines(spark, "{}"), CUSTOMER, loose).first()
    assert row.issues == ["identity_not_computable"] and row.identity is None


def test_values_that_rules_cannot_read(spark):
    made = lambda cells, feed: validation.local(
        lines(spark, '{"effective_to_utc": "soon", "nameplate_ceiling_mwh_th": "x"}').selectExpr("*", "array() :: array<string> as issues", "false as replay", *cells), feed
    ).first()
    time = "timestamp_ntz'2026-08-26 00:00:00'"
    period = [f"{time} as effective_from_utc", "null :: timestamp_ntz as effective_to_utc"]
    assert made(period, CUSTOMER).issues == ["business_rule_value_invalid"]
    cells = ["null :: timestamp_ntz as interval_start_utc", f"{time} as interval_end_utc"]
    assert made(cells, "commitment_schedule").issues == ["business_rule_value_invalid"]
    amounts = [f"null :: decimal(20,6) as {n}" for n in ("nameplate_ceiling_mwh_th", "operational_restriction_mwh_th", "deliverable_capacity_mwh_th")]
    whole = [f"{time} as interval_start_utc", f"{time} + interval 30 minutes as interval_end_utc", *amounts]
    assert made(whole, "delivery_point_capacity_assessment").issues == ["business_rule_value_invalid"]


def test_published_files_carry_hashes(spark, tmp_path):
    feeds = validation.validate({CUSTOMER: lines(spark, "[1]")})
    folder = f"{tmp_path}/out"
    bundle = spark.createDataFrame([("contract_terms", "dataset_missing")], "feed string, code string")
    validation.write_outcomes(feeds, folder, bundle)
    said = {(r.feed, r.outcome, r.code, r.rows) for r in spark.read.parquet(f"{folder}/report").collect()}
    assert said == {(CUSTOMER, "quarantined", "record_not_object", 1), ("contract_terms", "bundle", "dataset_missing", 0)}
    assert validation.altered(spark, folder).count() == 0
    spark.range(1).coalesce(1).write.mode("append").parquet(f"{folder}/report")
    assert validation.altered(spark, folder).count() == 1


def test_percent_encoding(spark):
    texts = ["a b", "ü/:*~-._+%", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(percent_encoded(F.col("t"))).collect()]
    assert got == [None if t is None else urllib.parse.quote(t, safe="-._~") for t in texts]


def test_duplicates_of_null_and_hot_identities(spark):
    rows = spark.createDataFrame([(None, "p", 1), (None, "p", 2), ("h", None, 3), ("h", None, 4), ("c", "p", 5), ("c", "q", 6)], "i string, p string, line int")
    got = {r.line: r.duplicate_class for r in relations.resolved_duplicates(rows, ["i"], "p", "line").collect()}
    assert got == {1: "accepted", 2: "replay", 3: "accepted", 4: "replay", 5: "conflict", 6: "conflict"}


def test_a_drained_stream_over_several_batches(spark, tmp_path):
    for n in range(3):
        spark.range(n + 1).selectExpr(f"timestamp_ntz'2026-08-26 00:0{n}:00' as ts", "'k' as k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("ts timestamp_ntz, k string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").selectExpr("ts :: timestamp as ts", "k")
    for folder, lateness in (("a", None), ("b", "1 day")):
        got = drained(counted_windows(source, "ts", ["k"], "30 minutes", lateness), f"{tmp_path}/{folder}", ["window_start", "k"]).collect()
        assert [(r.k, r.events) for r in got] == [("k", 6)]
