"""Form and behaviour over a player's history, as of a time: weighted scores and ratios with their sample sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.columns import DAY_US, clamp, decay, rate
from matchlake.operators.perspective import performance

HALF_LIFE_DAYS = 90.0
MIN_SAMPLE = 3
COMPLETION = {"walkover": 0.3, "retired": 0.5}


def opponent_weight(ranking: Column) -> Column:
    """1 for an unranked opponent, up to 1.5 for the best."""
    return F.when(ranking.isNull(), 1.0).otherwise(1.0 + 0.5 * clamp((200 - ranking) / 200.0, 0.0, 1.0))


def completion_weight(status: Column) -> Column:
    out = F.lit(1.0)
    for word, weight in reversed(COMPLETION.items()):
        out = F.when(status == word, weight).otherwise(out)
    return out


def form(history: DataFrame, as_of_us: int, half_life: float = HALF_LIFE_DAYS, sample: int = MIN_SAMPLE) -> DataFrame:
    """(player, form, form_n, confidence, recency): weighted mean of performance, the weights from age, opponent and
    completion; recency is the mean weight of age.

    ``history``: perspectives with status and opponent_ranking. Later matches than ``as_of_us`` count with full
    weight, as if they were now. Rows without a result don't count; a player of whom none is left is at 50 with
    confidence 0.
    """
    has = F.col("won").isNotNull()
    weight = decay((F.lit(as_of_us) - F.col("at")) / DAY_US, half_life) * opponent_weight(F.col("opponent_ranking")) * completion_weight(F.col("status"))
    score = F.when(F.col("status") == "walkover", F.col("won") * 100.0).otherwise(performance(F.col("won"), F.col("points_for"), F.col("points_against")))
    sums = history.groupBy("player").agg(F.count_if(has).alias("form_n"), F.sum(F.when(has, score * weight)).alias("__s"), F.sum(F.when(has, weight)).alias("__w"), F.avg(F.when(has, decay((F.lit(as_of_us) - F.col("at")) / DAY_US, half_life))).alias("recency"))
    return sums.select("player", "recency", F.coalesce(clamp(F.col("__s") / F.col("__w"), 0.0, 100.0), F.lit(50.0)).alias("form"), "form_n", F.least(F.lit(1.0), F.col("form_n") / float(max(1, sample))).alias("confidence"))


def pre_match_momentum(history: DataFrame, as_of_us: int, newest: int = 5, half_life: float = HALF_LIFE_DAYS, anchor: str = "oldest") -> DataFrame:
    """(player, momentum, momentum_n) from the ``newest`` matches with a result: decayed performance, moved by 5 for
    each match of a run, at most 20.

    ``anchor``: the run is taken at the "oldest" of those matches (as the original does) or at the "newest".
    """
    if anchor not in ("oldest", "newest"):
        raise ValueError("anchor is oldest or newest")
    order = Window.partitionBy("player").orderBy(F.col("at").desc(), F.col("match_id").desc())
    few = history.where("won is not null").withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= newest)
    far = Window.partitionBy("player").orderBy(F.col("__k").desc() if anchor == "oldest" else F.col("__k"))
    few = few.withColumn("__end", F.first("won").over(far))
    few = few.withColumn("__off", F.max((F.col("won") != F.col("__end")).cast("int")).over(far.rowsBetween(Window.unboundedPreceding, 0)))
    weight = decay((F.lit(as_of_us) - F.col("at")) / DAY_US, half_life)
    score = performance(F.col("won"), F.col("points_for"), F.col("points_against"))
    sums = few.groupBy("player").agg(F.sum(score * weight).alias("__s"), F.sum(weight).alias("__w"), F.count("*").alias("momentum_n"), ((2 * F.max("__end") - 1) * F.sum(1 - F.col("__off"))).alias("__run"))
    return sums.select("player", clamp(F.col("__s") / F.col("__w") + clamp(5.0 * F.col("__run"), -20.0, 20.0), 0.0, 100.0).alias("momentum"), "momentum_n")


def patterns(history: DataFrame, sample: int = MIN_SAMPLE) -> DataFrame:
    """(player, pattern, value, n, confidence) in long form; a pattern without observations has no row.

    confidence grows to 1 with ``sample`` observations. A history without close_losses and sets_against has no
    late_set_collapse.

    All ratios come from one aggregation, whose partial sums are made before the shuffle.
    """
    c = F.col
    n = lambda cond: F.count_if(cond)
    result, wins, losses = c("won").isNotNull(), c("won") == 1, c("won") == 0
    score = performance(c("won"), c("points_for"), c("points_against"))
    known = {"close_losses", "sets_against"} <= set(history.columns)
    sums = history.groupBy("player").agg(
        n(c("first_won") == 0).alias("first_lost"), n(c("first_won") == 1).alias("first_won"), n(c("first_won").isNotNull()).alias("first_n"),
        n((c("first_won") == 0) & wins).alias("comebacks"), n((c("first_won") == 0) & result).alias("comeback_n"), n((c("first_won") == 1) & losses).alias("thrown"), n((c("first_won") == 1) & result).alias("thrown_n"),
        n(c("decider_won") == 1).alias("deciders_won"), n(c("decider_won").isNotNull()).alias("deciders"), n(c("straight") == 1).alias("straight"), n(wins).alias("wins"), *[(F.sum(x) if known else F.lit(None).cast("bigint")).alias(n) for x, n in (("close_losses", "close"), ("sets_against", "lost_sets"))],
        F.stddev_pop(F.when(result, score)).alias("spread"), n(result).alias("results"),
    )
    ratios = [
        ("slow_starter", "first_lost", "first_n"), ("strong_first_set", "first_won", "first_n"), ("frequent_comeback", "comebacks", "comeback_n"),
        ("weak_after_winning_first_set", "thrown", "thrown_n"), ("high_deciding_set_performance", "deciders_won", "deciders"), ("straight_sets_tendency", "straight", "wins"),
        ("late_set_collapse", "close", "lost_sets"),
    ]
    rows = [F.struct(F.lit(p).alias("pattern"), rate(c(a), c(b)).alias("value"), c(b).cast("bigint").alias("n")) for p, a, b in ratios]
    spread = F.when(c("results") >= 2, F.least(F.lit(1.0), c("spread") / 50))
    rows.append(F.struct(F.lit("high_volatility").alias("pattern"), spread.alias("value"), c("results").cast("bigint").alias("n")))
    return sums.select("player", F.inline(F.array(*rows))).where("value is not null").withColumn("confidence", F.least(F.lit(1.0), F.col("n") / float(max(1, sample))))


def pressure_points(states: DataFrame, sample: int = MIN_SAMPLE) -> DataFrame:
    """(match_id, side, pattern, value, n, confidence): how many of a match's pressure points each side won.

    ``states``: ``sequences.point_states``. A match without such points has no row.
    """
    won = F.array(F.struct(F.lit(1).alias("side"), F.col("pressure_1").alias("won")), F.struct(F.lit(2).alias("side"), (F.col("pressure_n") - F.col("pressure_1")).alias("won")))
    each = states.where("pressure_n > 0").select("match_id", F.col("pressure_n").alias("n"), F.inline(won))
    return each.select("match_id", "side", F.lit("strong_pressure_point_performance").alias("pattern"), rate(F.col("won"), F.col("n")).alias("value"), "n", F.least(F.lit(1.0), F.col("n") / float(max(1, sample))).alias("confidence"))


def repeated_history(history: DataFrame) -> DataFrame:
    """(player, opponent, at, repeats): matches of one pair at one instant beyond the first."""
    return history.groupBy("player", "opponent", "at").agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")
