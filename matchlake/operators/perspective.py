"""A match seen from each of its two sides: one row per match and player, with all that a history needs.

Input matches: id, player_a, player_b, scheduled_us, start_us, done_us (microseconds), status, best_of,
winner, competition_id and sets ARRAY<STRUCT<set_number, a, b>>. Times are BIGINT, so that comparing and ordering
them never depends on a session's zone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETED = ("finished", "retired")
#: A set that is lost by at most so many points is lost late.
CLOSE = 2


def effective_time(completed: Column, started: Column, scheduled: Column) -> Column:
    """When a match took effect: its completion, else its start, else its schedule."""
    return F.coalesce(completed, started, scheduled)


def _points(sets: Column, side: str) -> Column:
    return F.aggregate(sets, F.lit(0).cast("bigint"), lambda total, s: total + F.coalesce(s[side], F.lit(0)).cast("bigint"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed here and not copied into the expressions that use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def perspectives(matches: DataFrame, more: Mapping[str, Column] | None = None) -> DataFrame:
    """Two rows a match. won is null without a winner. A null sets array counts as empty.

    ``more``: further columns out of those of ``matches``, which both rows get beside ``first``, whether it is that of
    player_a; then rows without a time are kept, too.

    The first set is the one with the smallest number. The last set decides if there are at least two and those
    before it are split evenly. A straight win is a win without a lost set and with at least one won.
    """
    ordered = F.sort_array(F.coalesce("sets", F.array().cast("array<struct<set_number:int,a:int,b:int>>")))
    m = _once(matches, "__s", ordered)
    first, last = F.try_element_at("__s", F.lit(1)), F.try_element_at("__s", F.lit(-1))
    won = lambda x, y: F.size(F.filter("__s", lambda s: s[x] > s[y]))
    close = lambda x, y: F.size(F.filter("__s", lambda s: (s[y] > s[x]) & (s[y] - s[x] <= CLOSE)))
    m = _once(m, "__m", F.struct(
        F.size("__s").alias("n"), won("a", "b").alias("wa"), won("b", "a").alias("wb"), close("a", "b").alias("ca"), close("b", "a").alias("cb"), _points(F.col("__s"), "a").alias("pa"), _points(F.col("__s"), "b").alias("pb"),
        *[F.when(e.isNotNull(), (e[x] > e[y]).cast("int")).alias(f"{name}_{x}") for name, e in (("first", first), ("last", last)) for x, y in (("a", "b"), ("b", "a"))],
        effective_time(F.col("done_us"), F.col("start_us"), F.col("scheduled_us")).alias("at"),
    ))
    s = F.col("__m")
    decider = (s["n"] >= 2) & (s["wa"] - s["last_a"] == s["wb"] - s["last_b"])
    sides = []
    for mine, other, us, them in (("a", "b", "player_a", "player_b"), ("b", "a", "player_b", "player_a")):
        won_it = F.when(F.col("winner").isNotNull(), (F.col("winner") == F.col(us)).cast("int"))
        sides.append(F.struct(
            F.col(us).alias("player"), F.col(them).alias("opponent"), won_it.alias("won"),
            s[f"w{mine}"].alias("sets_for"), s[f"w{other}"].alias("sets_against"), s[f"p{mine}"].alias("points_for"), s[f"p{other}"].alias("points_against"),
            s[f"c{mine}"].alias("close_losses"), s[f"first_{mine}"].alias("first_won"), decider.cast("int").alias("decider"), F.when(decider, s[f"last_{mine}"]).alias("decider_won"),
            ((won_it == 1) & (s[f"w{other}"] == 0) & (s[f"w{mine}"] > 0)).cast("int").alias("straight"), *([F.lit(mine == "a").alias("first")] if more is not None else []),
        ))
    duration = F.when(F.col("start_us").isNotNull() & F.col("done_us").isNotNull(), F.col("done_us") - F.col("start_us"))
    rows = m.select(
        F.col("id").alias("match_id"), s["at"].alias("at"), "competition_id", "best_of", duration.alias("duration_us"),
        (~F.col("status").isin(*COMPLETED)).cast("int").alias("incomplete"), *[c.alias(n) for n, c in (more or {}).items()], F.inline(F.array(*sides)),
    )
    return rows.where(F.col("player").isNotNull() & (F.col("at").isNotNull() | F.lit(more is not None)))


def performance(won: Column, points_for: Column, points_against: Column) -> Column:
    """0 to 100: the result, moved by up to 15 by the share of points; 50 without a result."""
    total = points_for + points_against
    outcome = won * F.lit(100.0)
    moved = F.when(total == 0, outcome).otherwise(outcome + (points_for - points_against) / F.when(total != 0, total) * 15.0)
    return F.when(won.isNull(), 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), moved)))
