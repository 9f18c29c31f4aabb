"""Point-in-time features of a player: windows over the matches strictly before a cutoff.

History and cutoffs are put on one time line per player, cutoffs before matches of the same instant, and running
totals along it hold at a cutoff exactly what is strictly before it. The last N matches are a difference of two
totals, found by one equi-join on (player, number of the match). So the work grows with the rows, not with
cutoffs times history, and every column is a ratio of integer sums, exact in any order.

Scale: the totals are made in two levels, whole blocks of time first and then inside each block, so one player with
a third of all matches is spread over as many tasks as there are blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.columns import DAY_US, HOUR_US, rate
from matchlake.operators.perspective import performance

WINDOWS = (5, 10, 20)
HALF_LIFE_DAYS = 90.0
BLOCK_DAYS = 30
#: Origin of the decay weights, which cancels out of every ratio.
_EPOCH_US = 1_577_836_800_000_000


def measures() -> dict[str, Column]:
    """What is summed over a history of perspectives."""
    one = F.lit(1).cast("bigint")
    flag = lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    won, first = F.col("won"), F.col("first_won")
    played = (F.col("sets_for") + F.col("sets_against")) > 0
    return {
        "n": one, "decided": flag(won.isNotNull()), "wins": flag(won), "sets_for": flag(F.col("sets_for")), "sets_against": flag(F.col("sets_against")),
        "points_for": flag(F.col("points_for")), "points_against": flag(F.col("points_against")), "set_rows": flag(played),
        "set_margin": flag(F.when(played, F.col("sets_for") - F.col("sets_against"))), "point_margin": flag(F.when(played, F.col("points_for") - F.col("points_against"))),
        "straight": flag(F.col("straight")), "deciders": flag(F.col("decider")), "decider_n": flag(F.col("decider_won").isNotNull()), "decider_wins": flag(F.col("decider_won")),
        "first_n": flag(first.isNotNull()), "first_wins": flag(first), "lost_first": flag((first == 0) & won.isNotNull()), "comebacks": flag((first == 0) & (won == 1)),
        "won_first": flag((first == 1) & won.isNotNull()), "thrown": flag((first == 1) & (won == 0)), "duration_n": flag(F.col("duration_us").isNotNull()),
        "duration": flag(F.col("duration_us")), "incomplete": flag(F.col("incomplete")),
    }


def decayed(half_life: float = HALF_LIFE_DAYS) -> dict[str, Column]:
    """Sums of floating point numbers: decay weights (times the result) and performance (and its square)."""
    weight = F.pow(F.lit(2.0), (F.col("at") - F.lit(_EPOCH_US)) / F.lit(half_life * DAY_US))
    score = performance(F.col("won"), F.col("points_for"), F.col("points_against")) - 50  # around 0: squares stay small
    has = F.col("won").isNotNull()
    zero = F.lit(0.0)
    return {
        "w": F.when(has, weight).otherwise(zero), "ww": F.when(has, weight * F.col("won")).otherwise(zero),
        "perf": F.when(has, score).otherwise(zero), "perf2": F.when(has, score * score).otherwise(zero),
    }


def _timeline(history: DataFrame, probes: DataFrame, key: Sequence[str], sums: Mapping[str, Column], block_days: int) -> DataFrame:
    """History and probes with inclusive running totals; a probe has what is strictly before it.

    ``probes``: key columns, probe (any struct or value), at. Total columns keep the names of ``sums``.
    """
    width = F.lit(block_days * DAY_US)
    rows = history.select(*key, "at", F.lit(1).alias("__hist"), F.col("match_id").cast("string").alias("__tie"), F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"), *[c.alias(n) for n, c in sums.items()])
    asked = probes.where(F.col("at").isNotNull()).select(*key, "at", F.lit(0).alias("__hist"), F.lit("").alias("__tie"), "probe", *[F.lit(0).cast(rows.schema[n].dataType).alias(n) for n in sums])
    both = rows.unionByName(asked).withColumn("__block", F.floor(F.col("at") / width))
    totals = both.groupBy(*key, "__block").agg(*[F.sum(n).alias(n) for n in sums])
    earlier = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*key, "__block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy(*key, "__block").orderBy("at", "__hist", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.join(base, [*key, "__block"])
    return joined.select(*key, "at", "__hist", "__tie", "probe", "__block", *[F.col(n).alias(f"__own_{n}") for n in sums], *[(F.sum(n).over(inside) + F.col(f"__b_{n}")).alias(n) for n in sums])


def window_rows(history: DataFrame, probes: DataFrame, windows: Sequence[int] = WINDOWS, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(probe, player, window_size, sums...) for each probe and window; window_size 0 is the whole history.

    ``history``: perspectives; ``probes``: probe, player, at. A probe before any match has zeros in every window.
    """
    sums = measures()
    line = _timeline(history, probes, ["player"], sums, block_days)
    kept = line.where("__hist = 0").select("probe", "player", F.struct(*sums).alias("now"), F.explode(F.array(*[F.lit(n) for n in (0, *windows)])).alias("window_size"))
    kept = kept.withColumn("__rank", F.when(F.col("window_size") > 0, F.col("now.n") - F.col("window_size")))
    past = line.where("__hist = 1").select(F.col("player").alias("__p"), F.col("n").alias("__rn"), F.struct(*sums).alias("then"))
    rows = kept.join(past, (F.col("player") == F.col("__p")) & (F.col("__rank") == F.col("__rn")), "left")
    return rows.select("probe", "player", "window_size", *[(F.col(f"now.{n}") - F.coalesce(F.col(f"then.{n}"), F.lit(0))).alias(n) for n in sums])


def window_formulas(c: Callable[[str], Column]) -> dict[str, Callable[[], Column]]:
    """Each feature of a window out of its sums, which ``c`` gives by name."""
    return {
        "matches_played": lambda: c("n"), "wins": lambda: c("wins"), "losses": lambda: c("decided") - c("wins"), "win_rate": lambda: rate(c("wins"), c("decided")),
        "sets_won": lambda: c("sets_for"), "sets_lost": lambda: c("sets_against"), "set_win_rate": lambda: rate(c("sets_for"), c("sets_for") + c("sets_against")),
        "points_won": lambda: c("points_for"), "points_lost": lambda: c("points_against"), "point_win_rate": lambda: rate(c("points_for"), c("points_for") + c("points_against")),
        "average_set_margin": lambda: rate(c("set_margin"), c("set_rows")), "average_point_margin": lambda: rate(c("point_margin"), c("set_rows")),
        "straight_sets_win_rate": lambda: rate(c("straight"), c("wins")), "straight_sets_n": lambda: c("wins"),
        "deciding_set_appearance_rate": lambda: rate(c("deciders"), c("n")), "deciding_set_win_rate": lambda: rate(c("decider_wins"), c("decider_n")), "deciding_set_n": lambda: c("decider_n"),
        "first_set_win_rate": lambda: rate(c("first_wins"), c("first_n")), "first_set_n": lambda: c("first_n"),
        "comeback_win_rate": lambda: rate(c("comebacks"), c("lost_first")), "comeback_n": lambda: c("lost_first"),
        "loss_rate_after_winning_first_set": lambda: rate(c("thrown"), c("won_first")), "loss_after_first_n": lambda: c("won_first"),
        "average_match_duration_minutes": lambda: rate(c("duration") / 60e6, c("duration_n")), "average_match_duration_n": lambda: c("duration_n"),
        "incomplete_match_count": lambda: c("incomplete"),
    }


def window_features(sums: DataFrame) -> DataFrame:
    """The features of each window out of its sums. A rate without observations is null, beside its count."""
    return sums.select("probe", "player", "window_size", *[f().alias(name) for name, f in window_formulas(F.col).items()])


def rest_and_workload(history: DataFrame, probes: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(probe, player, rest_hours, matches_24h, matches_7d): hours since the newest match, and recent counts.

    The far edge counts: a match exactly 24 hours (7 days) before the cutoff is in. Counts are differences of the
    number of matches before the cutoff and before the edge.
    """
    edges = F.array(*[F.struct(F.lit(k).alias("edge"), F.lit(h * HOUR_US).alias("back")) for k, h in (("now", 0), ("day", 24), ("week", 168))])
    asked = probes.select("player", F.col("at").alias("__at"), "probe", F.inline(edges)).select("player", (F.col("__at") - F.col("back")).alias("at"), F.struct("probe", "edge", "__at").alias("probe"))
    line = _timeline(history, asked, ["player"], {"n": F.lit(1).cast("bigint")}, block_days).where("__hist = 0")
    pick = lambda e: F.max(F.when(F.col("probe.edge") == e, F.col("n")))
    counts = line.groupBy(F.col("probe.probe").alias("p"), "player", F.col("probe.__at").alias("cut")).agg(pick("now").alias("now"), pick("day").alias("day"), pick("week").alias("week"))
    numbered = _timeline(history, asked.limit(0), ["player"], {"n": F.lit(1).cast("bigint")}, block_days).select(F.col("player").alias("__p"), F.col("n").alias("__rn"), F.col("at").alias("__last"))
    rows = counts.join(numbered, (F.col("player") == F.col("__p")) & (F.col("now") == F.col("__rn")), "left")
    return rows.select(F.col("p").alias("probe"), "player", ((F.col("cut") - F.col("__last")) / HOUR_US).alias("rest_hours"), (F.col("now") - F.col("day")).alias("matches_24h"), (F.col("now") - F.col("week")).alias("matches_7d"))


def form_and_volatility(history: DataFrame, probes: DataFrame, half_life: float = HALF_LIFE_DAYS, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(probe, player, recency_weighted_win_rate, volatility) over the matches with a result.

    The weight of a match halves every ``half_life`` days before the cutoff. As the cutoff's own factor cancels out
    of the weighted mean, weights are taken from a fixed origin and summed once. Volatility: standard deviation of
    the performance over 50, at most 1; null below two results.
    """
    sums = {**{"decided": measures()["decided"]}, **decayed(half_life)}
    line = _timeline(history, probes, ["player"], sums, block_days).where("__hist = 0")
    mean = F.col("perf") / F.col("decided")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("perf2") / F.col("decided") - mean * mean))
    return line.select("probe", "player", F.when(F.col("decided") > 0, F.col("ww") / F.col("w")).alias("recency_weighted_win_rate"), F.when(F.col("decided") >= 2, F.least(F.lit(1.0), spread / 50)).alias("volatility"))


def result_streak(history: DataFrame, probes: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(probe, player, result_streak): wins (positive) or losses (negative) in a row up to the cutoff.

    A newest match without result makes it 0. The streak is the distance to the last match with another result,
    whose number is a running maximum, made in blocks like the sums.
    """
    line = _timeline(history, probes, ["player"], {"n": F.lit(1).cast("bigint"), "won": F.coalesce(F.col("won"), F.lit(2)).cast("bigint")}, block_days)
    return streaks(line, "won")


def streaks(line: DataFrame, result: str) -> DataFrame:
    """(probe, player, result_streak) of a time line with n and ``result``: 1 won, 0 lost, 2 without a result."""
    marks = {f"last{r}": F.max(F.when((F.col("__hist") == 1) & (F.col(f"__own_{result}") == r), F.col("n"))) for r in (0, 1, 2)}
    tops = line.groupBy("player", "__block").agg(*[c.alias(n) for n, c in marks.items()])
    earlier = Window.partitionBy("player").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = tops.select("player", "__block", *[F.max(n).over(earlier).alias(f"__b_{n}") for n in marks])
    inside = Window.partitionBy("player", "__block").orderBy("at", "__hist", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = line.join(base, ["player", "__block"])
    rows = rows.select("probe", "player", "__hist", "n", *[F.coalesce(F.greatest(c.over(inside), F.col(f"__b_{n}")), F.lit(0)).alias(n) for n, c in marks.items()]).where("__hist = 0")
    lost, won, none = F.col("last0"), F.col("last1"), F.col("last2")
    streak = F.when(F.col("n") == 0, 0).when(won == F.col("n"), F.col("n") - F.greatest(lost, none)).when(lost == F.col("n"), F.greatest(won, none) - F.col("n")).otherwise(0)
    return rows.select("probe", "player", streak.cast("bigint").alias("result_streak"))
