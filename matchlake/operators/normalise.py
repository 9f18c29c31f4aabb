"""Live feed rows normalised; what can't be is returned beside them with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the feeds and the status each stands for.
STATUS_WORDS = {
    "scheduled": "scheduled", "not_started": "scheduled", "live": "live", "in_progress": "live",
    "finished": "finished", "ended": "finished", "cancelled": "cancelled", "canceled": "cancelled",
}


def status(raw: Column) -> Column:
    """Canonical status of a word, blanks and case aside; null if it is unknown."""
    table = F.create_map(*[F.lit(x) for kv in STATUS_WORDS.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(raw)))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def split(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with reason)."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def players(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with provider_player_id, full_name, country_code, world_ranking; good ones as id, name, country, ranking beside the
    other columns. Reasons: blank player id, blank name."""
    reason = F.when(_blank(F.col("provider_player_id")), "blank player id").when(_blank(F.col("full_name")), "blank name")
    good, bad = split(rows, reason)
    return good.withColumnsRenamed({"provider_player_id": "id", "full_name": "name", "country_code": "country", "world_ranking": "ranking"}), bad


def odds(rows: DataFrame, instant: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with provider_match_id, bookmaker and decimal_odds; ``instant``: when they were captured, null if unreadable.

    Good rows have a trimmed bookmaker. Reasons, the first that holds: blank match, blank bookmaker, odds not above 1
    (or none), unreadable time.
    """
    low = F.col("decimal_odds").isNull() | F.isnan("decimal_odds") | (F.col("decimal_odds") <= 1.0)
    reason = F.when(_blank(F.col("provider_match_id")), "blank match id").when(_blank(F.col("bookmaker")), "blank bookmaker").when(low, "odds not above 1").when(instant.isNull(), "unreadable time")
    good, bad = split(rows, reason)
    return good.withColumn("bookmaker", F.trim("bookmaker")), bad


def matches(rows: DataFrame, instant: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with provider_match_id, player_a, player_b, status_raw; good rows get the canonical status."""
    same = F.trim("player_a") == F.trim("player_b")
    reason = (
        F.when(_blank(F.col("provider_match_id")), "blank match id").when(_blank(F.col("player_a")) | _blank(F.col("player_b")), "blank player").when(same, "same player")
        .when(status(F.col("status_raw")).isNull(), "unknown status").when(instant.isNull(), "unreadable time")
    )
    good, bad = split(rows, reason)
    return good.withColumn("status", status(F.col("status_raw"))), bad
