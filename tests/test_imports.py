import json

import pytest
from pyspark.sql import functions as F

from matchlake.operators import adapt, datasets, duplicates, identity, sequences, validate
from matchlake.plans import imports

RAW = "provider string, provider_record_id string, record_type string, payload string, source_batch_id string, source_timestamp timestamp, fetched_at timestamp"


def raw(spark, *payloads, kind="match", provider="rallydesk"):
    return spark.createDataFrame([(provider, f"r{i}", kind, p if p is None or isinstance(p, str) else json.dumps(p), "b", None, None) for i, p in enumerate(payloads)], RAW).withColumn("__REASON", F.lit(0))


def test_mapping(spark):
    good = {"player_a_id": "a", "status": "FT", "best_of": 5, "scheduled_at": "2024-01-01T10:00:00+02:00", "sets": [{"set_number": 1, "a": 11, "b": 5}, "odd", {"set_number": None, "a": "x"}]}
    rows, rejected = adapt.adapt(raw(spark, good, {"status": "???", "scheduled_at": "soon", "best_of": "many"}, "[1]", "nothing", None, ""), "match", imports.mapping("rallydesk"))
    one, two = rows.orderBy("provenance.provider_record_id").collect()
    assert (one.status, one.best_of, [tuple(s) for s in one.sets], len(one.provenance.warnings)) == ("finished", 5, [(1, 11, 5), (None, None, None)], 1)
    assert (two.status_raw, two.status, two.scheduled_at, two.best_of, two.sets, two.provenance.warnings) == ("???", None, None, None, [], ["unknown status ???"])
    assert {r.reason for r in rejected.collect()} == {"payload is not a JSON object"} and rejected.count() == 4
    strict = imports.mapping("rallydesk")
    strict = adapt.ProviderMapping(strict.provider, strict.fields, strict.statuses, "reject")
    assert [r.reason for r in adapt.adapt(raw(spark, {"status": "???"}), "match", strict)[1].collect()] == ["unknown status ???"]
    assert adapt.unmapped(raw(spark, {}, kind="umpire"), {"rallydesk": strict}).count() == 1 and adapt.unmapped(raw(spark, {}), {"rallydesk": strict}).count() == 0
    for bad in ({"statuses": {"x": "paused"}}, {"unknown_status": "guess"}, {"fields": {"umpire": {}}}):
        with pytest.raises(ValueError):
            adapt.ProviderMapping(**{"provider": "p", "fields": {}, **bad})


def codes(spark, **change):
    row = {"player_a_external_id": "a", "player_b_external_id": "b", "scheduled_us": 10, "start_us": 20, "done_us": 30, "status_raw": "FT", "status": "finished", "best_of": 3, "winner_external_id": "a", "sets": [(1, 11, 5), (2, 11, 5)], **change}
    df = spark.createDataFrame([tuple(row.values())], "player_a_external_id string, player_b_external_id string, scheduled_us bigint, start_us bigint, done_us bigint, status_raw string, status string, best_of int, winner_external_id string, sets array<struct<set_number:int,player_a_points:int,player_b_points:int>>")
    df = df.withColumn("provenance", F.expr("named_struct('source_timestamp', timestamp'2024-01-01', 'ingested_at', timestamp'2024-01-01')"))
    return sorted(i.code for i in validate.match_issues(df, now_us=1000).head().issues)


def test_every_finding(spark):
    assert codes(spark) == []
    cases = {
        "missing_player_a": {"player_a_external_id": "", "winner_external_id": "b", "sets": []}, "same_player": {"player_b_external_id": "a"}, "missing_scheduled_at": {"scheduled_us": None},
        "missing_status": {"status_raw": None}, "unmapped_status": {"status": None}, "invalid_status": {"status": "odd"}, "invalid_best_of": {"best_of": 0, "sets": []}, "negative_set_score": {"sets": [(1, 11, -1), (2, 11, 5)]},
        "missing_set_score": {"sets": [(1, 11, None), (2, 11, 5)]}, "missing_set_number": {"sets": [(None, 11, 5)]}, "duplicate_set_number": {"sets": [(1, 11, 5), (1, 11, 5)]}, "winner_not_participant": {"winner_external_id": "z", "sets": []},
        "completed_without_winner": {"winner_external_id": None}, "scheduled_with_winner": {"status": "scheduled"}, "score_result_mismatch": {"winner_external_id": "b"}, "sets_exceed_best_of": {"best_of": 1},
        "completion_before_start": {"done_us": 5}, "future_historical_record": {"done_us": 10**12},
    }
    for code, change in cases.items():
        assert codes(spark, **change) == [code], code
    assert codes(spark, sets=None) == []


def test_outcomes(spark):
    issue = lambda *s: F.lit([]).cast(validate._ISSUE) if not s else F.array(*[F.struct(F.lit(x).alias("severity"), F.lit("c").alias("code"), F.lit("f").alias("field_path"), F.lit("s").alias("stage")) for x in s])
    row = spark.range(1).select(*[validate.outcome(issue(*s), strict).alias(n) for n, s, strict in (("a", (), True), ("b", ("warning",), True), ("c", ("error",), True), ("d", ("error",), False), ("e", ("error", "fatal"), False))]).head()
    assert tuple(row) == ("accept", "accept", "reject", "warn", "reject")


STAGED = "id string, winner string, scheduled_us bigint, status string, sets array<struct<n:int,a:int,b:int>>, arrived bigint, row_id bigint"


def test_match_repeats(spark):
    s = [(1, 11, 5), (2, 11, 7)]
    staged = [
        ("new", "a", 1, "finished", s, 1, 1), ("new", "a", 1, "finished", s[::-1], 2, 2), ("new", "b", 1, "finished", s, 3, 3),
        ("plan", None, 1, "scheduled", [], 1, 4), ("plan", "a", 2, "finished", s, 2, 5), ("plan", "a", 2, "finished", s, 3, 6), ("plan", "a", 2, "finished", None, 4, 7),
        ("old", "a", 1, "finished", s, 1, 8), ("old", "a", 9, "finished", s, 1, 9), ("tie", None, None, None, None, 1, 10), ("tie", None, None, None, None, 1, 11),
    ]
    stored = spark.createDataFrame([("old", "a", 1, "finished", s)], STAGED.replace(", arrived bigint, row_id bigint", ""))
    out = {r.row_id: (r.outcome, r.reason) for r in duplicates.match_outcomes(spark.createDataFrame(staged, STAGED), stored).collect()}
    ins, skip, merge = ("inserted", None), ("skipped_idempotent", None), ("merged_safe", None)
    assert out == {1: ins, 2: skip, 3: ("rejected_conflict", "winner"), 4: ins, 5: merge, 6: skip, 7: ("rejected_conflict", "set scores"), 8: skip, 9: ("rejected_conflict", "scheduled_at"), 10: ins, 11: skip}


def test_odds_repeats_and_cross_provider(spark):
    staged = spark.createDataFrame([("k", 2.0, 1, 1), ("k", 2.0, 2, 2), ("k", 3.0, 3, 3), ("s", 5.0, 1, 4), ("n", None, 1, 5), ("n", None, 1, 6)], "id string, decimal_odds double, arrived bigint, row_id bigint")
    out = {r.row_id: r.outcome for r in duplicates.odds_outcomes(staged, spark.createDataFrame([("s", 4.0)], "id string, decimal_odds double")).collect()}
    assert out == {1: "inserted", 2: "skipped_idempotent", 3: "rejected_conflict", 4: "rejected_conflict", 5: "inserted", 6: "skipped_idempotent"}
    m = spark.createDataFrame([(1, "p", "a", "b", 0), (2, "q", "b", "a", 300_000_000), (3, "q", "a", "b", 301_000_000), (4, "p", "a", "b", 10), (5, "q", "a", None, 0)], "id int, provider string, player_a string, player_b string, scheduled_us bigint")
    assert {tuple(r) for r in duplicates.cross_provider(m).collect()} == {(1, 2), (2, 1), (4, 2)}


def test_identities(spark):
    ids = [("i1", "anna berg", ["ana berg"], "SWE", None, [("p", "1")]), ("i2", "carl dahl", None, None, None, []), ("i3", "evangelina lund", [], "SWE", None, []), ("i4", "evangelina lunde", [], "SWE", None, [])]
    schema = "id string, normalized_name string, aliases array<string>, country string, birth_date date, external_ids array<struct<provider:string,provider_player_id:string>>"
    cands = [(1, "anna berg", None, None, "p", "1"), (2, "zzzz yyyy", None, None, "p", "1"), (3, "ana berg", None, None, None, None), (4, "carl dahl", "NOR", None, "x", "9"), (5, "anna berg", "NOR", None, None, None), (6, "evangelina lund", None, None, None, None), (7, None, None, None, None, None), (8, "quite other", None, None, None, None)]
    c = spark.createDataFrame(cands, "candidate_id int, normalized_name string, country string, birth_date date, external_provider string, external_player_id string")
    for block in (5000, 1):
        out = {r.candidate_id: (r.outcome, r.identity_id) for r in identity.resolve(c, spark.createDataFrame(ids, schema), block).collect()}
        assert out == {1: ("matched", "i1"), 2: ("rejected", None), 3: ("matched", "i1"), 4: ("matched", "i2"), 5: ("created", None), 6: ("ambiguous", None), 7: ("created", None), 8: ("created", None)}
    assert {r.outcome for r in identity.resolve(c, spark.createDataFrame([], schema)).collect()} == {"created"}


def test_bounds_and_true_margins(spark):
    import difflib
    import random

    rng = random.Random(1)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.choice((0, 3, 8, 30, 63, 64, 65, 90)))) for _ in range(300)]
    bounds = identity._Bounds(names)
    for name in names[:40] + ["", "zzz", "abcd" * 60]:
        most = bounds.most(name) if name else []
        assert all(difflib.SequenceMatcher(None, name, o).ratio() <= m + 1e-12 for o, m in zip(names, most) if o)
    schema = "id string, normalized_name string, aliases array<string>, country string, birth_date date, external_ids array<struct<provider:string,provider_player_id:string>>"
    ids = [("i1", "anna lindqvist", [], None, None, []), ("i2", "hanna lindberg", [], None, None, []), ("i3", "otto", [], None, None, [])]
    c = spark.createDataFrame([(1, "anna lindqvist", None, None, None, None), (2, "zzz", None, None, None, None), (3, "ott", None, None, None, None)], "candidate_id int, normalized_name string, country string, birth_date date, external_provider string, external_player_id string")
    for block in (5000, 1):
        got = {r.candidate_id: r for r in identity.resolve(c, spark.createDataFrame(ids, schema), block).collect()}
        second = difflib.SequenceMatcher(None, "anna lindqvist", "hanna lindberg").ratio()
        assert got[1].outcome == "matched" and abs(got[1].margin - (1 - second)) < 1e-12 and got[2].score is None
        assert got[3].outcome == "created" and abs(got[3].score - 6 / 7) < 1e-12
    one = identity.resolve(c, spark.createDataFrame(ids[:1], schema)).where("candidate_id = 1").head()
    assert one.margin == one.score == 1.0


def test_splits(spark):
    df = spark.createDataFrame([(i, i // 2, 1) for i in range(10)], "match_id bigint, cutoff_us bigint, label int")
    placed = datasets.positions(df, part_rows=20)
    assert [r.pos for r in placed.orderBy("match_id").collect()] == list(range(10))
    assert [r.split for r in datasets.holdout(placed).orderBy("pos").collect()] == ["train"] * 6 + ["validation"] * 2 + ["test"] * 2
    assert datasets.holdout(datasets.positions(df.limit(2))).count() == 0
    folds = {}
    for r in datasets.walk_forward(placed, 3).collect():
        folds.setdefault((r.fold, r.split), set()).add(r.pos)
    assert folds == {(i, s): set(v) for i in range(3) for s, v in (("train", range(2 * i + 2)), ("test", range(2 * i + 2, 2 * i + 4)))}
    folds = {}
    for r in datasets.rolling_folds(placed, 4, 3).collect():
        folds.setdefault((r.fold, r.split), set()).add(r.pos)
    assert folds == {(0, "train"): {0, 1, 2, 3}, (0, "test"): {4, 5, 6}, (1, "train"): {3, 4, 5, 6}, (1, "test"): {7, 8, 9}}


def test_leaks_are_found(spark):
    of = spark.createDataFrame([("m1", 10), ("m2", 20), ("m2", 20)], "match_id string, cutoff_us bigint")
    sources = spark.createDataFrame([("m1", "m1"), ("m2", "s")], "match_id string, source_id string")
    known = spark.createDataFrame([("m1", "p", "1", 5), ("s", "p", "1", 20)], "id string, provider string, provider_match_id string, at bigint")
    splits = spark.createDataFrame([("m1", "train", 5), ("m1", "test", 1)], "match_id string, split string, pos bigint")
    report = datasets.leakage_report(of, sources, known, splits, ["Winner", "ranking"])
    assert report.count() == 7 and report.where("passed").count() == 0
    with pytest.raises(ValueError, match="sources_before_cutoff"):
        datasets.assert_no_leakage(report)
    datasets.assert_no_leakage(datasets.leakage_report(of.limit(1), sources.limit(0), known.limit(1)))


def test_momentum_of_points(spark):
    score, rows = [0, 0], []
    for i, w in enumerate([1, 2, 1, 1, 1, 1, 1], 1):
        score[w - 1] += 1
        rows.append(("m", i, 1, w, *score))
    p = spark.createDataFrame(rows, "match_id string, seq int, set_number int, winner int, score_1 int, score_2 int")
    s = sequences.point_states(p).head()
    assert (s.points, s.trailing_points, s.lead_changes, s.pressure_n, s.recent_net) == (7, 5, 0, 0, 5)
    m = sequences.momentum(p).head()
    assert m.momentum_1 > 50 and abs(m.momentum_1 + m.momentum_2 - 100) < 1e-9 and 0 < m.confidence < 1
    sets = [("m", 1, 1, 1, 11, 5), ("m", 2, 2, 2, 5, 11), ("m", 3, 3, 2, 4, 4), ("m", 4, 4, 1, 11, 9), ("m", 5, 5, 1, 3, 0)]
    t = sequences.set_states(spark.createDataFrame(sets, p.schema)).head()
    assert (t.trailing_sets, t.losses_1, t.recoveries_1, t.losses_2, t.recoveries_2) == (2, 1, 1, 2, 1)
    assert sequences.momentum(p.limit(0)).count() == 0
