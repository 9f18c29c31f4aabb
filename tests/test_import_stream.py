import json
from datetime import datetime, timedelta

import pytest

from matchlake.operators import adapt
from matchlake.plans.imports import mapping
from matchlake.streaming import imports, pipeline

T0 = datetime(2026, 1, 1)


def iso(t):
    return t.strftime("%Y-%m-%dT%H:%M:%S+00:00")


def match(day, winner, sets):
    at = T0 + timedelta(days=day)
    return {"competition_id": "open", "competition_name": "Open", "player_a_id": "x1", "player_b_id": "x2", "scheduled_at": iso(at), "actual_start_at": iso(at), "completed_at": iso(at + timedelta(hours=1)), "status": "COMPLETED", "best_of": 5, "winner_id": winner, "sets": [{"set_number": i + 1, "a": a, "b": b} for i, (a, b) in enumerate(sets)]}


def odds(match_id, value, minute):
    return {"match_id": match_id, "bookmaker": "Book", "selection_id": "x1", "decimal_odds": value, "captured_at": iso(T0 + timedelta(minutes=minute)), "market_id": "winner"}


def ranking(player, place, day):
    return {"player_id": player, "ranking": place, "ranking_points": 6000.0, "effective_at": iso(T0 + timedelta(days=day))}


WON, LOST = [(11, 7), (9, 11), (11, 8)], [(7, 11), (11, 9), (8, 11)]
RECORDS = [
    ("x1", "player", {"name": "Meo Lang", "country": "CHN"}), ("x2", "player", {"name": "Fandor Zhukov", "country": "CHN"}),
    ("open", "competition", {"name": "Open", "country": "CHN", "level": "1", "format": "singles", "season": "2026", "indoor": True, "active_from": iso(T0), "active_to": iso(T0 + timedelta(days=14))}),
    ("m1", "match", match(0, "x1", WON)), ("o1", "odds", odds("m1", 1.8, 0)), ("o2", "odds", odds("m1", 1.75, 30)), ("r1", "ranking", ranking("x1", 2, 0)), ("r2", "ranking", ranking("x2", 5, 0)),
    ("x3", "player", {"name": "Mao Lang", "country": "CHN"}), ("m1", "match", match(0, "x1", WON)), ("m1", "match", match(0, "x2", LOST)),
    ("x4", "player", {"name": "Mio Lang", "country": "CHN"}),  # as near to the one as to the other
    ("m2", "match", match(9, "x2", LOST)), ("o3", "odds", odds("m2", 1.9, 9 * 1440)), ("r3", "ranking", ranking("x1", 3, 9)),
]


def write(spark, folder, number, rows):
    made = [(100 * number + i, "feed", rid, kind, json.dumps(payload), f"batch{number}", T0, T0 + timedelta(days=20, seconds=100 * number + i)) for i, (rid, kind, payload) in enumerate(rows)]
    spark.createDataFrame(made, imports.RAW).coalesce(1).write.parquet(f"{folder}/.part{number}")
    target = next((folder / f".part{number}").glob("*.parquet"))
    target.rename(folder / f"b{number}.parquet")


def test_sequence_of_two_batches(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    store, registry = pipeline.Store(spark, str(tmp_path / "store"), buckets=2), adapt.Registry(mapping("feed"))
    known = [(f"known{n}", name, [], "CHN", None, [("feed", x)]) for n, (x, name) in enumerate((("x1", "meo lang"), ("x3", "mao lang")))]
    store["identities"].add(spark.createDataFrame(known, pipeline.TABLES["identities"]))
    write(spark, folder, 1, RECORDS[:8])
    run = lambda: pipeline.import_stream(spark, str(folder), store, str(tmp_path / "cp"), registry)
    first = run()
    assert first[0]["outcomes"] == {("player", "inserted"): 2, ("competition", "inserted"): 1, ("match", "inserted"): 1, ("odds", "inserted"): 2, ("ranking", "inserted"): 2}
    write(spark, folder, 2, RECORDS[8:])
    second = run()
    assert second[0]["outcomes"] == {("player", "inserted"): 1, ("player", "quarantined"): 1, ("match", "skipped_idempotent"): 1, ("match", "rejected_conflict"): 1, ("match", "inserted"): 1, ("odds", "inserted"): 1, ("ranking", "inserted"): 1}
    assert run() == []
    with pytest.raises(pipeline.CheckpointVersionError):
        pipeline.import_stream(spark, str(folder), store, str(tmp_path / "cp"), registry, version="2.0.0")
    assert store.fingerprint() == "players=3,matches=2,odds=3,rankings=3,competitions=1"
    assert [(r.reason, r.provider_record_id) for r in store["quarantine"].read().collect()] == [("ambiguous_identity", "x4")]
    assert [(r.conflicting_field, r.provider_record_id) for r in store["conflicts"].read().collect()] == [("winner", "m1")]
    assert {(r.id, r.winner) for r in store["matches"].read().collect()} == {("feed:m1", "known0"), ("feed:m2", "player:feed:x2")}
    # The same messages once more change nothing.
    before = store.fingerprint()
    again = pipeline.import_batch(spark.read.schema(imports.RAW).parquet(str(folder)), store, registry)
    assert store.fingerprint() == before and again["ranking", "skipped_idempotent"] == 3 and again["player", "merged_safe"] == 3
