from pyspark.sql import functions as F

from matchlake.functions.columns import DAY_US
from matchlake.operators import datasets, quotes, snapshots
from matchlake.sources import export

SETS = "array<struct<set_number:int,a:int,b:int>>"
SCHEMA = f"id bigint, player_a string, player_b string, scheduled_us bigint, start_us bigint, done_us bigint, status string, best_of int, winner string, competition_id string, sets {SETS}, completeness int"
WON, LOST = [(1, 11, 5), (2, 11, 9)], [(1, 5, 11), (2, 11, 8), (3, 6, 11)]


def matches(spark, rows):
    return spark.createDataFrame([(i, a, b, d * DAY_US, d * DAY_US, d * DAY_US + 3_600_000_000, "finished", 5, w, "c", s, q) for i, a, b, d, w, s, q in rows], SCHEMA)


ROWS = [(1, "p", "q", 1, "p", WON, 100), (2, "q", "p", 2, "q", WON, 80), (3, "p", "r", 3, "p", WON, 60), (4, "p", "q", 10, "p", LOST, 100), (5, "s", "t", 11, "s", WON, 100)]


def test_one_row_a_match_with_all_that_was_known(spark):
    rank = spark.createDataFrame([("p", 5 * DAY_US, 1, 3), ("q", 5 * DAY_US, 2, 9), ("p", 10 * DAY_US, 3, 1)], "player string, at bigint, id bigint, ranking int")
    made = snapshots.snapshots(matches(spark, ROWS), rank)
    inputs = {r.target_match_id: r for r in snapshots.engine_inputs(made).collect()}
    got = {r.target_match_id: r for r in made.collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    four, a, b, pair, made = got[4], got[4].player_a_features, got[4].player_b_features, got[4].matchup_features, got[4].provenance
    assert (a.observation_count, b.observation_count, pair.meetings) == (3, 2, 2) and [w.window_size for w in a.windows] == [0, 5, 10, 20]
    assert a.windows[0].wins == 2 and abs(a.windows[0].win_rate - 2 / 3) < 1e-12 and a.result_streak == 1 and b.result_streak == 1 and pair.win_rate_a == 0.5
    assert (a.ranking, b.ranking, pair.ranking_differential) == (3, 9, 6.0)  # the ranking of the day itself isn't known yet
    assert abs(made.data_quality_score - (100 + 80 + 60) / 3) < 1e-9 and made.warnings == [] and made.missing_feature_names == []
    assert made.newest_source_us == 3 * DAY_US + 3_600_000_000 < four.as_of_us
    first = got[1].provenance
    assert first.data_quality_score == 65.0 and len(first.warnings) == 3 and "matchup.player_a_win_rate" in first.missing_feature_names and len(first.missing_feature_names) == 5
    assert got[1].provenance.repository_fingerprint == got[5].provenance.repository_fingerprint != four.provenance.repository_fingerprint
    again = {r.target_match_id: r.provenance.input_fingerprint for r in snapshots.snapshots(matches(spark, ROWS[::-1]), rank).collect()}
    assert again == {k: v.provenance.input_fingerprint for k, v in got.items()} and len(set(again.values())) == 5
    assert (inputs[4].wins_a, inputs[4].wins_b, inputs[4].last_played_us) == (1, 1, 2 * DAY_US + 3_600_000_000) and (inputs[1].wins_a, inputs[1].wins_b, inputs[1].last_played_us) == (0, 0, None)


def test_empty_and_exported_rows(spark):
    assert snapshots.snapshots(matches(spark, [])).count() == 0
    m = matches(spark, ROWS)
    made, _ = datasets.examples(m.select("id"), m)
    flat = export.flatten(snapshots.training_rows(made, snapshots.snapshots(m)))
    assert {"id", "as_of", "player_a_won", "features.provenance.cutoff", "features.matchup_features.meetings", "provenance_fingerprint"} <= set(flat.columns) and flat.columns == sorted(flat.columns)
    row = flat.where(F.col("target_match_id") == "4").select("as_of", F.col("`features.provenance.cutoff`").alias("cutoff"), "id").head()
    assert (row.as_of, row.cutoff, row.id) == ("1970-01-11T00:00:00+00:00", "1970-01-11T00:00:00Z", "ex-4")


def test_each_planted_leak_is_found(spark):
    of = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "match_id bigint, cutoff_us bigint")
    known = spark.createDataFrame([(i, "p", i, 50 * i) for i in range(9)], "id bigint, provider string, provider_match_id bigint, at bigint")
    splits = datasets.holdout(datasets.positions(of))
    fine = dict(sources=[(1, 0), (2, 1)], odds=[(1, 100)], shots=[(1, 100), (2, 200), (3, 300)], names=["win_rate"])

    def failed(**other):
        how = fine | other
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        report = datasets.leakage_report(how.get("of", of), frame(how["sources"], "match_id bigint, source_id bigint"), how.get("known", known), how.get("splits", splits), how["names"], frame(how["odds"], "match_id bigint, at bigint"), frame(how["shots"], "target_match_id bigint, as_of_us bigint"))
        rows = report.collect()
        assert len(rows) == 9
        return {r.check for r in rows if not r.passed}

    assert failed() == set()
    assert failed(sources=[(3, 3)]) == {"target_not_in_sources"}
    assert failed(sources=[(1, 2)]) == {"sources_before_cutoff"}
    assert failed(odds=[(1, 101)]) == {"odds_at_or_before_cutoff"}
    assert failed(shots=[(1, 100), (2, 201), (3, 300)]) == failed(shots=[(1, 100), (2, 200)]) == {"snapshot_matches_example"}
    assert failed(names=["win_rate", "Winner_Id"]) == {"no_forbidden_fields"}
    assert failed(known=known.unionByName(spark.createDataFrame([(99, "p", 1, 5)], known.schema))) == {"provider_mapping_consistent"}
    assert failed(splits=splits.withColumn("pos", -F.col("pos"))) == {"splits_in_order"}
    assert "no_example_in_two_splits" in failed(splits=splits.unionByName(splits.withColumn("split", F.lit("test"))))


def test_quotes(spark):
    rows = [(1, 10, 5, "b", 2.0, 1.8), (1, 11, 9, "z", 3.0, 1.5), (1, 12, 9, "a", 2.5, 1.6), (2, 20, 1, "a", 2.0, 2.0), (None, 30, 1, "a", 9.0, 9.0), (3, 31, None, "a", 9.0, 9.0)]
    q = spark.createDataFrame(rows, "match_id bigint, quote_id bigint, at bigint, bookmaker string, odds_a double, odds_b double")
    got = {r.match_id: r for r in quotes.summary(spark.range(1, 5).select(F.col("id").alias("match_id")), q).collect()}
    one = got[1]
    assert (one.quotes, one.primary_id, one.primary_bookmaker, one.first_odds, one.last_odds, one.movement) == (3, 12, "a", 2.0, 2.5, 0.25) and abs(one.disagreement - (0.5 / 3) ** 0.5) < 1e-9
    assert (got[2].quotes, got[2].movement, got[2].disagreement) == (1, None, None) and got[3].quotes == got[4].quotes == 0
    cut = spark.createDataFrame([(1, 9), (2, 0)], "match_id bigint, cutoff_us bigint")
    assert {r.quote_id for r in quotes.known_quotes(q, cut).collect()} == {10, 11, 12}


def _many():
    rows = [(i, "pqrs"[i % 4], "qrsp"[(i * 7) % 4 if (i * 7) % 4 != (i % 4 + 3) % 4 else i % 4], i // 3, None if i % 11 == 0 else "pqrs"[i % 4] if i % 2 else "qrsp"[(i * 7) % 4 if (i * 7) % 4 != (i % 4 + 3) % 4 else i % 4], (WON, LOST, [])[i % 3], 50 + i % 50) for i in range(90)]
    return rows + [(900 + i, f"x{i}", "p", 20 + i, f"x{i}", WON, 70) for i in range(5)]


def test_players_with_many_rows_get_the_same_as_others(spark, monkeypatch):
    rank = spark.createDataFrame([("p", 5 * DAY_US, 1, 3), ("q", 5 * DAY_US, 2, 9), ("x3", 10 * DAY_US, 3, 1)], "player string, at bigint, id bigint, ranking int")
    flat = lambda r: [round(x, 9) if isinstance(x, float) else flat(x) if isinstance(x, (list, tuple)) else x for x in r]
    found = []
    for limit in (1_000, 20, 0):  # nobody, the four players with most rows, everybody
        monkeypatch.setattr(snapshots, "HEAVY", limit)
        found.append(sorted(map(flat, snapshots.snapshots(matches(spark, _many()), rank).collect())))
    assert len(found[0]) == 86 and found[0] == found[1] == found[2]


def test_only_the_sums_that_are_asked_for_travel(spark):
    made = snapshots.snapshots(matches(spark, ROWS), of_windows=("win_rate",))
    window = {r.target_match_id: r for r in made.collect()}[4].player_a_features.windows[0]
    assert window.asDict() == {"window_size": 0, "win_rate": 2 / 3}


def test_numbers_travel_in_the_narrowest_type():
    import pyarrow as pa

    from matchlake.operators import parts

    n = 20_000
    rows = pa.table({"small": pa.array([i % 7 for i in range(n)], pa.int64()), "none": pa.array([None] * n, pa.int64()), "wide": pa.array([2**40 + i % 3 for i in range(n)], pa.int64()), "__part": pa.array([i % 2 for i in range(n)], pa.int32())})
    packs = parts._packs(rows)
    read = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in packs["rows"]]
    assert packs["part"].to_pylist() == [0, 1] and read[0].schema.field("small").type == pa.int8()
    assert read[1].cast(rows.drop_columns("__part").schema)["wide"].to_pylist() == rows["wide"].to_pylist()[1::2]
    assert sum(len(x.as_py()) for x in packs["rows"]) < 4 * n  # 24 bytes a row as they are


def test_written_rows_leave_no_shuffle_files(spark):
    from matchlake.session import written

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    rows = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before and rows.count() == 7


def test_leakage_checks_leave_no_shuffle_to_the_report(spark):
    """Each check is done with before the next, so their shuffle files are never on disk together."""
    of = spark.createDataFrame([(1, 10), (2, 20), (2, 20)], "match_id bigint, cutoff_us bigint")
    known = spark.createDataFrame([(1, "p", 1, 9), (2, "p", 2, 30)], "id bigint, provider string, provider_match_id bigint, at bigint")
    report = datasets.leakage_report(of, spark.createDataFrame([(2, 1), (1, 2)], "match_id bigint, source_id bigint"), known)
    assert "Exchange" not in report._jdf.queryExecution().executedPlan().toString()
    assert {r.check: r.violations for r in report.collect()} == {"no_forbidden_fields": 0, "target_not_in_sources": 0, "sources_before_cutoff": 1, "no_duplicate_examples": 1, "provider_mapping_consistent": 0}
