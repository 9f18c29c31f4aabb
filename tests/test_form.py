import pytest
from pyspark.sql import functions as F

from matchlake.functions.columns import DAY_US
from matchlake.operators import form, normalise

HISTORY = "player string, opponent string, match_id string, at bigint, won int, points_for bigint, points_against bigint, status string, opponent_ranking int, first_won int, decider_won int, straight int"
NOW = 100 * DAY_US


def row(i, won, age=0, pf=10, pa=10, status="finished", rank=None, first=None, decider=None, straight=0, player="p"):
    return (player, "o", f"m{i}", NOW - age * DAY_US, won, pf, pa, status, rank, first, decider, straight)


def history(spark, *rows):
    return spark.createDataFrame(list(rows), HISTORY).withColumn("FORM", F.lit("clash"))


def test_form_weights(spark):
    h = history(spark, row(1, 1), row(2, 0, age=90), row(3, None), row(4, None, player="new"))
    got = {r.player: (r.form, r.form_n, r.confidence) for r in form.form(h, NOW).collect()}
    assert abs(got["p"][0] - 100 / 1.5) < 1e-9 and got["p"][1:] == (2, 2 / 3) and got["new"] == (50.0, 0, 0.0)
    assert form.form(history(spark, row(1, 1), row(2, 0, age=-400)), NOW).head().form == 50.0
    assert abs(form.form(history(spark, row(1, 1, rank=1), row(2, 0, status="retired")), NOW).head().form - 100 * 1.4975 / 1.9975) < 1e-9
    assert form.form(history(spark, row(1, 1, pf=0, pa=99, status="walkover")), NOW).head().form == 100.0


def test_run_is_taken_at_the_anchor(spark):
    h = history(spark, *[row(i, w, age=i) for i, w in enumerate([1, 1, 1, 0, 0, 1])])
    value = lambda a: form.pre_match_momentum(h, NOW, anchor=a).head().momentum
    assert abs(value("newest") - value("oldest") - 25) < 1e-9
    with pytest.raises(ValueError):
        value("middle")


def test_patterns_have_no_row_without_observations(spark):
    h = history(spark, row(1, 1, first=0), row(2, 0, age=1, first=0), row(3, 1, age=2, first=1, straight=1), row(4, None, player="q"))
    got = {(r.player, r.pattern): (r.value, r.n) for r in form.patterns(h).collect()}
    assert got[("p", "slow_starter")] == (2 / 3, 3) and got[("p", "frequent_comeback")] == (0.5, 2) and got[("p", "straight_sets_tendency")] == (0.5, 2)
    assert ("p", "high_deciding_set_performance") not in got and not [k for k in got if k[0] == "q"]
    late = {(r.player, r.pattern): (r.value, r.n, r.confidence) for r in form.patterns(h.withColumns({"close_losses": F.when(F.col("player") == "p", 1).otherwise(0), "sets_against": F.when(F.col("player") == "p", 2).otherwise(0)})).collect()}
    assert late[("p", "late_set_collapse")] == (0.5, 6, 1.0) and ("q", "late_set_collapse") not in late and ("p", "late_set_collapse") not in got
    assert form.repeated_history(history(spark, row(1, 1), row(2, 1), row(3, 1, age=1))).head().repeats == 1


def test_live_rows(spark):
    odds = spark.createDataFrame([("m", " B ", 2.0, "t"), ("", "b", 2.0, "t"), ("m", " ", 2.0, "t"), ("m", "b", 1.0, "t"), ("m", "b", None, "t"), ("m", "b", float("nan"), "t"), ("m", "b", 2.0, None)], "provider_match_id string, bookmaker string, decimal_odds double, at string")
    good, bad = normalise.odds(odds, F.col("at"))
    assert [r.bookmaker for r in good.collect()] == ["B"] and sorted(r.reason for r in bad.collect()) == ["blank bookmaker", "blank match id", "odds not above 1", "odds not above 1", "odds not above 1", "unreadable time"]
    matches = spark.createDataFrame([("m", "a", "b", " LIVE ", "t"), ("m", "a", "a", "live", "t"), ("m", None, "b", "live", "t"), ("m", "a", "b", "paused", "t"), ("m", "a", "b", "ended", None)], "provider_match_id string, player_a string, player_b string, status_raw string, at string")
    good, bad = normalise.matches(matches, F.col("at"))
    assert [r.status for r in good.collect()] == ["live"] and sorted(r.reason for r in bad.collect()) == ["blank player", "same player", "unknown status", "unreadable time"]
