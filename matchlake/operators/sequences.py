"""Ordered point sequences: streaks, lead changes, set winners and momentum, as windows over (match, seq).

A match's points are bounded by the sport, so a match is a natural unit of work; the matches are spread by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRESSURE, RECENT = 9, 10


def point_states(points: DataFrame) -> DataFrame:
    """One row a match: what momentum is made of.

    ``points``: match_id, seq (unique in a match), set_number, winner (1 or 2), score_1, score_2 (after the point).
    trailing_points: signed run of points at the end. lead_changes: how often the leader, carried through ties and
    across sets, changed. pressure_n, pressure_1: points with both scores at least PRESSURE, and those of side 1.
    recent_net: points of side 1 minus side 2 among the last RECENT.
    """
    order = Window.partitionBy("match_id").orderBy("seq")
    back = Window.partitionBy("match_id").orderBy(F.col("seq").desc())
    leader = F.when(F.col("score_1") > F.col("score_2"), 1).when(F.col("score_2") > F.col("score_1"), 2)
    rows = points.withColumn("__lead", F.last(leader, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"__was": F.lag("__lead").over(order), "__back": F.row_number().over(back), "__end": F.first("winner").over(back)})
    rows = rows.withColumn("__broken", F.max((F.col("winner") != F.col("__end")).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    pressed = (F.col("score_1") >= PRESSURE) & (F.col("score_2") >= PRESSURE)
    count = lambda c: F.sum(c.cast("bigint"))
    sign = F.when(F.max("__end") == 1, 1).otherwise(-1)
    return rows.groupBy("match_id").agg(
        F.count("*").alias("points"), (sign * F.sum(1 - F.col("__broken"))).cast("bigint").alias("trailing_points"),
        F.coalesce(count(F.col("__lead") != F.col("__was")), F.lit(0)).alias("lead_changes"), count(pressed).alias("pressure_n"), count(pressed & (F.col("winner") == 1)).alias("pressure_1"),
        F.sum(F.when(F.col("__back") <= RECENT, F.when(F.col("winner") == 1, 1).otherwise(-1)).otherwise(0)).cast("bigint").alias("recent_net"),
    )


def set_winners(points: DataFrame) -> DataFrame:
    """(match_id, set_number, first_seq, winner) by the last point of each set; sets that end tied have none."""
    last = points.groupBy("match_id", "set_number").agg(F.min("seq").alias("first_seq"), F.max_by(F.struct("score_1", "score_2"), "seq").alias("s"))
    winner = F.when(F.col("s.score_1") > F.col("s.score_2"), 1).when(F.col("s.score_2") > F.col("s.score_1"), 2)
    return last.select("match_id", "set_number", "first_seq", winner.alias("winner")).where("winner is not null")


def set_states(points: DataFrame) -> DataFrame:
    """(match_id, trailing_sets, losses_1, recoveries_1, losses_2, recoveries_2): runs of sets and recoveries.

    A recovery is a lost set followed by a won one; the last set is no loss yet.
    """
    order = Window.partitionBy("match_id").orderBy("first_seq")
    back = Window.partitionBy("match_id").orderBy(F.col("first_seq").desc())
    rows = set_winners(points).withColumns({"__next": F.lead("winner").over(order), "__end": F.first("winner").over(back)})
    rows = rows.withColumn("__broken", F.max((F.col("winner") != F.col("__end")).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    lost = lambda p: (F.col("winner") != p) & F.col("__next").isNotNull()
    sides = [x for p in (1, 2) for x in (count(lost(p)).alias(f"losses_{p}"), count(lost(p) & (F.col("__next") == p)).alias(f"recoveries_{p}"))]
    return rows.groupBy("match_id").agg((F.when(F.max("__end") == 1, 1).otherwise(-1) * F.sum(1 - F.col("__broken"))).cast("bigint").alias("trailing_sets"), *sides)


def _run_score(run: Column, step: float, most: int) -> Column:
    return F.when(run.isNull() | (run == 0), 50.0).otherwise(50 + F.signum(run.cast("double")) * F.least(F.lit(50.0), F.least(F.abs(run), F.lit(most)) * step))


def momentum(points: DataFrame, min_points: int = 8) -> DataFrame:
    """(match_id, momentum_1, momentum_2, confidence) from 0 to 100: a weighted mean of five components of side 1."""
    s = point_states(points).join(set_states(points), "match_id", "left")
    bounded = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    recovery = F.when(F.coalesce("losses_1", F.lit(0)) == 0, 50.0).otherwise(100.0 * F.col("recoveries_1") / F.when(F.col("losses_1") > 0, F.col("losses_1")))
    pressure = F.when(F.col("pressure_n") == 0, 50.0).otherwise(100.0 * F.col("pressure_1") / F.when(F.col("pressure_n") > 0, F.col("pressure_n")))
    one = bounded(
        0.25 * _run_score(F.col("trailing_points"), 5.0, 10) + 0.20 * _run_score(F.col("trailing_sets"), 15.0, 1000) + 0.15 * recovery + 0.20 * pressure + 0.20 * bounded(50.0 + F.col("recent_net") * 10.0)
    )
    calm = 1 - F.least(F.lit(0.5), F.col("lead_changes") / 10.0)
    return s.select("match_id", one.alias("momentum_1"), (100 - one).alias("momentum_2"), (F.least(F.lit(1.0), F.col("points") / float(min_points)) * calm).alias("confidence"))
