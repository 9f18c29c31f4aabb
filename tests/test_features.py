from pyspark.sql import functions as F

from matchlake.functions.columns import DAY_US, HOUR_US
from matchlake.operators import asof, matchup, rolling
from matchlake.operators.perspective import perspectives

MATCH = "id string, player_a string, player_b string, scheduled_us bigint, start_us bigint, done_us bigint, status string, best_of int, winner string, competition_id string, sets array<struct<set_number:int,a:int,b:int>>"


def match(i, day, sets, winner="p1", a="p1", b="p2", status="finished", comp="c", best=5, at=None):
    t = day * DAY_US if at is None else at
    done = status in ("finished", "retired")
    return (f"m{i}", a, b, t, t if done else None, t + HOUR_US if done else None, status, best, winner if done else None, comp, [(n + 1, *s) for n, s in enumerate(sets)])


def history(spark, *rows):
    return perspectives(spark.createDataFrame(list(rows), MATCH).withColumn("AT", F.lit("clash")))


def probes(spark, *rows):
    return spark.createDataFrame(list(rows), "player string, at bigint, probe int")


def window(spark, rows, at=100 * DAY_US, size=0, player="p1"):
    out = rolling.window_features(rolling.window_rows(history(spark, *rows), probes(spark, (player, at, 1))))
    return out.where(F.col("window_size") == size).head().asDict()


STRAIGHT, LONG = [(11, 5), (11, 5)], [(11, 5), (9, 11), (11, 5)]
DECIDER_WON, DECIDER_LOST = [(11, 5), (7, 11), (11, 9)], [(11, 5), (7, 11), (9, 11)]


def test_one_win(spark):
    w = window(spark, [match(1, 1, STRAIGHT)])
    assert (w["matches_played"], w["wins"], w["sets_won"], w["sets_lost"], w["points_won"], w["points_lost"]) == (1, 1, 2, 0, 22, 10)
    assert w["point_win_rate"] == 22 / 32 and w["average_match_duration_minutes"] == 60 and w["average_set_margin"] == 2


def test_straight_deciding_first_and_comeback(spark):
    w = window(spark, [match(1, 1, STRAIGHT), match(2, 2, LONG)])
    assert (w["straight_sets_win_rate"], w["straight_sets_n"]) == (0.5, 2)
    w = window(spark, [match(1, 1, DECIDER_WON), match(2, 2, DECIDER_LOST, "p2")])
    assert (w["deciding_set_appearance_rate"], w["deciding_set_win_rate"], w["deciding_set_n"]) == (1.0, 0.5, 2)
    w = window(spark, [match(1, 1, [(5, 11), (11, 8), (11, 6)]), match(2, 2, [(11, 5), (5, 11), (7, 11)], "p2")])
    assert (w["comeback_win_rate"], w["comeback_n"], w["loss_rate_after_winning_first_set"], w["loss_after_first_n"]) == (1.0, 1, 1.0, 1)


def test_cancelled_counts_as_played_but_not_decided(spark):
    w = window(spark, [match(1, 1, STRAIGHT), match(2, 2, [], status="cancelled")])
    assert (w["matches_played"], w["incomplete_match_count"], w["win_rate"]) == (2, 1, 1.0)


def test_no_history_is_null_not_zero(spark):
    w = window(spark, [match(1, 200, STRAIGHT)])
    assert w["matches_played"] == 0 and w["win_rate"] is None and w["point_win_rate"] is None and w["comeback_n"] == 0


def test_cutoff_is_strict_and_windows_take_the_newest(spark):
    rows = [match(i, i, STRAIGHT, "p1" if i > 4 else "p2") for i in range(1, 10)]
    end = 9 * DAY_US + HOUR_US
    assert window(spark, rows, end)["matches_played"] == 8 and window(spark, rows, end + 1)["matches_played"] == 9
    assert [window(spark, rows, end + 1, n)["wins"] for n in (5, 10, 0)] == [5, 5, 5]
    assert window(spark, rows, end, 5)["wins"] == 4


def test_blocks_of_time_change_nothing(spark):
    rows = [match(i, 40 * i, LONG if i % 3 else STRAIGHT, "p1" if i % 2 else "p2") for i in range(1, 40)]
    p = probes(spark, *[("p1", 90 * DAY_US * k, k) for k in range(20)])
    h = history(spark, *rows)
    for f in (rolling.window_rows, rolling.rest_and_workload, rolling.result_streak):
        assert sorted(f(h, p, block_days=30).collect()) == sorted(f(h, p, block_days=10**5).collect())


def streak(spark, results, *more):
    rows = [match(i, i, STRAIGHT, {"W": "p1", "L": "p2"}.get(r, "p1"), status="finished" if r in "WL" else "cancelled") for i, r in enumerate(results, 1)]
    return rolling.result_streak(history(spark, *rows) if rows else history(spark, match(1, 200, STRAIGHT)), probes(spark, ("p1", 100 * DAY_US, 1))).head().result_streak


def test_streaks(spark):
    assert [streak(spark, r) for r in ("LWW", "WLL", "W", "WWC", "CW", "WCW", "")] == [2, -2, 1, 0, 1, 1, 0]


def test_rest_workload_form_volatility(spark):
    h = history(spark, match(1, 1, STRAIGHT), match(2, 8, STRAIGHT, "p2"), match(3, 9, [], status="scheduled"))
    cut = 9 * DAY_US + HOUR_US
    r = rolling.rest_and_workload(h, probes(spark, ("p1", cut, 1), ("p1", 0, 2), ("nobody", cut, 3))).orderBy("probe").collect()
    assert [(x.rest_hours, x.matches_24h, x.matches_7d) for x in r] == [(1.0, 2, 2), (None, 0, 0), (None, 0, 0)]
    f = rolling.form_and_volatility(h, probes(spark, ("p1", cut, 1))).head()
    w1, w2 = 0.5 ** ((cut - DAY_US - HOUR_US) / DAY_US / 90), 0.5 ** ((cut - 8 * DAY_US - HOUR_US) / DAY_US / 90)
    assert abs(f.recency_weighted_win_rate - w1 / (w1 + w2)) < 1e-12
    scores = (100.0, 12 / 32 * 15)  # 100 + 5.6 is cut to 100; a lost match keeps its points' share
    assert abs(f.volatility - abs(scores[0] - scores[1]) / 2 / 50) < 1e-9


def test_head_to_head(spark):
    rows = [match(1, 1, DECIDER_WON), match(2, 2, STRAIGHT, "p2", comp="d", best=7), match(3, 5, STRAIGHT), match(4, 3, STRAIGHT, a="p1", b="p9")]
    p = spark.createDataFrame([(1, "p1", "p2", 10 * DAY_US, "c", 5), (2, "p2", "p1", 10 * DAY_US, None, None), (3, "p1", "p7", 10 * DAY_US, "c", 5)], "probe int, player string, opponent string, at bigint, competition_id string, best_of int")
    one, two, three = matchup.head_to_head(history(spark, *rows), p).orderBy("probe").collect()
    assert (one.meetings, one.deciding_set_meetings, one.deciding_set_win_rate_a, one.competition_meetings, one.competition_win_rate_a, one.format_meetings) == (3, 1, 1.0, 2, 1.0, 2)
    assert abs(one.win_rate_a - 2 / 3) < 1e-12 and abs(two.win_rate_a - 1 / 3) < 1e-12 and abs(one.days_since_last - (5 - 1 / 24)) < 1e-9
    assert (two.competition_meetings, two.competition_win_rate_a) == (0, None)
    assert (three.meetings, three.win_rate_a, three.win_rate_b, three.days_since_last, three.recent_n) == (0, None, None, None, 0)


def test_latest_strict_inclusive_and_nulls(spark):
    rows = spark.createDataFrame([("k", 5, 1, "a"), ("k", 5, 2, None), ("k", 9, 3, "c"), (None, 1, 4, "x")], "k string, at bigint, tie int, v string")
    p = spark.createDataFrame([("k", 5, 1), ("k", 6, 2), ("k", 9, 3), (None, 9, 4), ("z", 9, 5), ("k", None, 6)], "k string, at bigint, probe int")
    got = lambda inclusive: [r.v for r in asof.latest(rows, p, ["k"], ["v", "tie"], "tie", inclusive).orderBy("probe").collect()]
    assert got(False) == [None, None, None, None, None, None] and got(True) == [None, None, "c", None, None, None]
    ties = asof.latest(rows, p, ["k"], ["tie"], "tie").orderBy("probe").collect()
    assert [r.tie for r in ties] == [None, 2, 2, None, None, None]


def test_differentials(spark):
    side = lambda *v: spark.createDataFrame([(1, *v)], "probe int, win_rate double, rest_hours double, matches_7d bigint, volatility double, ranking int")
    d = matchup.differentials(side(0.75, 10.0, 3, None, 3), side(0.25, 4.0, 1, 0.5, 50)).head()
    assert (d.form_differential, d.rest_differential_hours, d.workload_differential, d.volatility_differential, d.ranking_differential) == (0.5, 6.0, 2, None, 47.0)
