"""Point-in-time features of a pair of players: their earlier meetings, seen from the side of the first player."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.columns import DAY_US, rate
from matchlake.operators import rolling

RECENT = 5


def meetings(history: DataFrame) -> DataFrame:
    """The perspectives keyed by (player, opponent), so a pair of players in this order has its own time line."""
    return history.where(F.col("opponent").isNotNull())


#: What is summed over the meetings of a pair.
SUMS = ("n", "decided", "wins", "set_rows", "set_margin", "deciders", "decider_n", "decider_wins")


def meeting_sums(history: DataFrame, probes: DataFrame, recent: int = RECENT, block_days: int = rolling.BLOCK_DAYS) -> DataFrame:
    """One row for each probe (as for ``head_to_head``): probe, at, SUMS, recent_decided and recent_wins, last_us, and n, decided
    and wins of the meetings with the probe's competition and format, after these words; null where the probe has none."""
    key = ["player", "opponent"]
    sums = {n: c for n, c in rolling.measures().items() if n in SUMS}
    asked = probes.select(*key, "at", F.struct("probe", "at", "competition_id", "best_of").alias("probe"))
    line = rolling._timeline(meetings(history), asked, key, sums, block_days)
    now = line.where("__hist = 0").select(*key, "probe", *sums)
    past = line.where("__hist = 1").select(F.col("player").alias("__p"), F.col("opponent").alias("__o"), F.col("n").alias("__rn"), F.col("at").alias("__at"), F.struct("decided", "wins").alias("then"))
    same = (F.col("player") == F.col("__p")) & (F.col("opponent") == F.col("__o"))
    rows = now.join(past.drop("__at"), same & (F.col("__rn") == F.col("n") - recent), "left").drop("__p", "__o", "__rn")
    rows = rows.withColumns({f"recent_{x}": F.col(x) - F.coalesce(f"then.{x}", F.lit(0)) for x in ("decided", "wins")}).drop("then")
    parts = rows.join(past.select("__p", "__o", "__rn", F.col("__at").alias("last_us")), same & (F.col("__rn") == F.col("n")), "left").drop("__p", "__o", "__rn")
    for name, column in (("competition", "competition_id"), ("format", "best_of")):
        narrow = ["player", "opponent", column]
        few = {n: c for n, c in sums.items() if n in ("n", "decided", "wins")}
        ask = probes.where(F.col(column).isNotNull()).select(*narrow, "at", "probe")
        found = rolling._timeline(meetings(history).where(F.col(column).isNotNull()), ask, narrow, few, block_days).where("__hist = 0")
        found = found.select(F.col("probe").alias(f"__{name}"), *[F.col(x).alias(f"{name}_{x}") for x in few])
        parts = parts.join(found, F.col("probe.probe") == F.col(f"__{name}"), "left").drop(f"__{name}")
    return parts.select(F.col("probe.probe").alias("probe"), F.col("probe.at").alias("at"), *[c for c in parts.columns if c not in ("probe", *key)])


def meeting_features(c: Callable[[str], Column]) -> list[Column]:
    """What is known of a pair's meetings, out of the columns of ``meeting_sums``, which ``c`` gives by name."""
    a = rate(c("wins"), c("decided"))
    narrow = [x for name in ("competition", "format") for x in (F.coalesce(c(f"{name}_n"), F.lit(0)).alias(f"{name}_meetings"), rate(c(f"{name}_wins"), c(f"{name}_decided")).alias(f"{name}_win_rate_a"))]
    return [
        c("n").alias("meetings"), a.alias("win_rate_a"), (1 - a).alias("win_rate_b"), rate(c("recent_wins"), c("recent_decided")).alias("recent_win_rate_a"), c("recent_decided").alias("recent_n"),
        rate(c("set_margin"), c("set_rows")).alias("average_set_margin_a"), c("deciders").alias("deciding_set_meetings"), rate(c("decider_wins"), c("decider_n")).alias("deciding_set_win_rate_a"),
        ((c("at") - c("last_us")) / DAY_US).alias("days_since_last"), *narrow,
    ]


def head_to_head(history: DataFrame, probes: DataFrame, recent: int = RECENT, block_days: int = rolling.BLOCK_DAYS) -> DataFrame:
    """One row for each probe: probe, player, opponent, at, competition_id, best_of.

    Rates over meetings with a result; the recent rate over those of the newest ``recent`` meetings that have one;
    the margin over meetings with sets. The competition and format columns count the meetings with the probe's
    value and are 0 and null where that value is null. Without meetings every rate is null.
    """
    return meeting_sums(history, probes, recent, block_days).select("probe", *meeting_features(F.col))


def differentials(a: DataFrame, b: DataFrame) -> DataFrame:
    """a minus b of form, rest, workload and volatility, and b's ranking minus a's; null if a side is unknown.

    ``a`` and ``b``: probe, win_rate, rest_hours, matches_7d, volatility, ranking.
    """
    x, y = a.alias("x"), b.alias("y")
    minus = lambda c: F.col(f"x.{c}") - F.col(f"y.{c}")
    return x.join(y, F.col("x.probe") == F.col("y.probe")).select(
        F.col("x.probe").alias("probe"), minus("win_rate").alias("form_differential"), minus("rest_hours").alias("rest_differential_hours"),
        minus("matches_7d").alias("workload_differential"), minus("volatility").alias("volatility_differential"), (F.col("y.ranking") - F.col("x.ranking")).cast("double").alias("ranking_differential"),
    )
