from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from matchlake.operators import adapt, duplicates, ingest, validate
from matchlake.plans.imports import mapping

SETS = "array<struct<set_number:int,player_a_points:int,player_b_points:int>>"
PROVENANCE = "struct<provider:string,provider_record_id:string,source_batch_id:string,source_timestamp:timestamp,ingested_at:timestamp,raw_fingerprint:string,mapping_version:string,warnings:array<string>,raw_payload_ref:string>"
MATCH = f"match_row_id bigint, provenance {PROVENANCE}, player_a_external_id string, player_b_external_id string, scheduled_us bigint, start_us bigint, done_us bigint, status_raw string, status string, best_of int, winner_external_id string, sets {SETS}"
T0, HOUR = datetime(2024, 1, 1), 3_600_000_000


def provenance(provider, record, n):
    return (provider, record, "b", None, T0 + timedelta(minutes=n), "f", "1", [], None)


def row(n, provider="p", record="m1", a="1", b="2", at=0, status="finished", winner="1", sets=((1, 11, 5), (2, 11, 7)), done=HOUR):
    return (n, provenance(provider, record, n), a, b, at, at, None if done is None else at + done, status, status, 5, winner, [tuple(s) for s in sets])


INDEX = [("p", "1", "A"), ("p", "2", "B"), ("q", "x", "B"), ("q", "y", "A"), ("p", "3", "C")]


def outcomes(spark, rows, stored=None):
    df = validate.match_issues(spark.createDataFrame(rows, MATCH).withColumn("extra", F.lit("clash")), None)
    index = spark.createDataFrame(INDEX, "provider string, external_id string, internal_id string")
    return {r.match_row_id: (r.outcome, r.reason, r.detail) for r in ingest.match_results(df, index, stored).collect()}


def test_each_fate_of_a_match(spark):
    rows = [
        row(1), row(2), row(3, winner="2", sets=((1, 5, 11), (2, 7, 11))), row(4, record="m2", b="9"), row(5, record="m3", status=None), row(6, record="m4", sets=((1, 5, 5), (2, 11, 7), (3, 11, 2))),
        row(7, "q", "k1", "x", "y", at=200_000_000, winner="y", sets=((1, 5, 11), (2, 7, 11))), row(8, "q", "k2", "x", "y", at=400_000_000, winner="y", sets=((1, 5, 11), (2, 7, 11))), row(9, record=None),
        row(10, record="m5", at=99 * HOUR, status="scheduled", winner=None, sets=(), done=None), row(11, record="m6", winner="3"),
    ]
    rows[9] = (*rows[9][:5], None, *rows[9][6:])  # a scheduled match has no start
    got = outcomes(spark, rows)
    assert got == {
        1: ("inserted", None, None), 2: ("skipped_idempotent", None, None), 3: ("rejected_conflict", "winner", None), 4: ("quarantined", "missing_critical_field", None), 5: ("quarantined", "unsupported_status", None),
        6: ("quarantined", "invalid_record", None), 7: ("quarantined", "duplicate_conflict", "p:m1"), 8: ("inserted", None, None), 9: ("quarantined", "missing_critical_field", None),
        10: ("inserted", None, None), 11: ("quarantined", "conflicting_result", None),
    }
    assert outcomes(spark, []) == {}


def test_against_stored_matches(spark):
    stored = spark.createDataFrame([("p:m1", "p", "A", "B", None, 0, "scheduled", []), ("q:k9", "q", "B", "A", None, 50 * HOUR, "scheduled", [])], f"id string, provider string, player_a string, player_b string, winner string, scheduled_us bigint, status string, sets {SETS}")
    got = outcomes(spark, [row(1), row(2), row(3, record="m7", at=50 * HOUR + 300_000_000), row(4, record="m8", at=50 * HOUR + 300_000_001)], stored)
    assert got == {1: ("merged_safe", None, None), 2: ("skipped_idempotent", None, None), 3: ("quarantined", "duplicate_conflict", "q:k9"), 4: ("inserted", None, None)}


def test_one_key_on_a_third_of_the_rows(spark):
    rows = [row(n) for n in range(1, 101)] + [row(200 + n, record=f"x{n}", at=(n + 10) * HOUR) for n in range(200)]
    got = outcomes(spark, rows)
    assert sum(o == "skipped_idempotent" for o, _, _ in got.values()) == 99 and sum(o == "inserted" for o, _, _ in got.values()) == 201


def test_no_stored_record_may_be_so(spark):
    rows = [row(1), row(2, sets=((0, 11, 5),)), row(3, status="scheduled", winner=None), row(4, status="live"), (5, provenance("p", "m", 5), "1", "2", 9 * HOUR, None, HOUR, "finished", "finished", 5, "1", []), row(6, sets=((1, 4, 4),))]
    got = {r.match_row_id: set(r.v) for r in spark.createDataFrame(rows, MATCH).select("match_row_id", validate.record_violations().alias("v")).collect()}
    assert got == {1: set(), 2: {"set_number_not_positive"}, 3: {"scheduled_with_play"}, 4: {"winner_before_end"}, 5: {"completion_before_schedule"}, 6: {"set_tied"}}


def test_reports_and_records(spark):
    schema = "table_name string, row_id bigint, provider string, provider_record_id string, internal_id string, outcome string, reason string, detail string"
    rows = [("imported_match", 1, "p", "a", "p:a", "inserted", None, None), ("imported_match", 2, "p", "a", "p:a", "rejected_conflict", "winner", None), ("imported_odds", 3, "p", None, None, "quarantined", "missing_critical_field", None), ("imported_match", 4, "q", "b", None, "quarantined", "invalid_score", None), ("imported_match", 5, "q", "b", None, "quarantined", "unsupported_status", None)]
    of = spark.createDataFrame(rows, schema)
    assert {(r.id, r.reason) for r in ingest.quarantine(of).collect()} == {("quarantine:odds:p:row 3", "missing_critical_field"), ("quarantine:match:q:b", "unsupported_status")}
    assert [(r.id, r.conflicting_field) for r in ingest.conflicts(of).collect()] == [("conflict:match:p:a", "winner")]
    issues = spark.createDataFrame([("p", "error"), ("p", "fatal"), ("p", "fatal"), ("p", "fatal"), ("q", "warning")], "provider string, severity string")
    got = {r.provider: r for r in ingest.report(of, issues).collect()}
    assert (got["p"].read, got["p"].accepted, got["p"].rejected, got["p"].quarantined) == (3, 1, 1, 1) and abs(got["p"].structural_validity_rate - (1 - 4 / 3)) < 1e-12
    assert got[None].read == 5 and abs(got[None].ambiguity_rate - 3 / 5) < 1e-12 and abs(got[None].ambiguity_rate - (got["p"].ambiguity_rate * 3 + got["q"].ambiguity_rate * 2) / 5) < 1e-12
    assert ingest.report(of.limit(0), issues.limit(0)).count() == 0


def test_registry_and_unmapped(spark):
    known = adapt.Registry(mapping("p"))
    known.register(mapping("q"))
    assert known.providers() == ["p", "q"] and known.get("q").provider == "q"
    with pytest.raises(adapt.UnknownProviderError):
        known.get("r")
    raw = spark.createDataFrame([(1, "p", "1", "player", '{"name": "x"}', "b", None, T0), (2, "q", "2", "player", "[]", "b", None, T0), (3, "r", "3", "player", "{}", "b", None, T0), (4, "p", "4", "coach", "{}", "b", None, T0), (5, None, "5", None, None, "b", None, T0)], "delivery_id bigint, provider string, provider_record_id string, record_type string, payload string, source_batch_id string, source_timestamp timestamp, fetched_at timestamp")
    rows, rejected = adapt.adapt_all(raw, "player", known)
    assert [r.name for r in rows.collect()] == ["x"] and [r.delivery_id for r in rejected.collect()] == [2]
    assert {r.delivery_id for r in adapt.unmapped(raw, known.mappings()).collect()} == {3, 4, 5}


def test_near_matches_of_another_provider_that_came_earlier(spark):
    schema = "id string, provider string, player_a string, player_b string, scheduled_us bigint, arrived timestamp, row_id bigint"
    df = spark.createDataFrame([("a", "p", "1", "2", 0, T0, 1), ("b", "q", "2", "1", 0, T0, 2), ("c", "p", "1", "2", 0, T0, 3), ("d", "q", "1", "2", None, T0, 4)], schema)
    assert {(r.id, r.duplicate_of) for r in duplicates.cross_provider(df, 300, df).collect()} == {("b", "a"), ("c", "b")}
    assert {r.id for r in duplicates.cross_provider(df, 300).collect()} == {"a", "b", "c"}
