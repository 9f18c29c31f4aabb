"""Staged validation of import rows: each finding is a row of an array, each decision a column.

Stages: structural (is it there), semantic (does it agree with itself), temporal (can it have happened then). Every
check is a built-in expression over one row, so validation adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.operators.adapt import STATUSES

COMPLETED = ("finished", "retired")
TOLERANCE_SECONDS = 60
_ISSUE = "array<struct<severity:string,code:string,field_path:string,stage:string>>"


def _if(condition: Column, severity: str, code: str, path: str, stage: str) -> Column:
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(path).alias("field_path"), F.lit(stage).alias("stage")))


def _each(count: Column, severity: str, code: str, path: str, stage: str) -> Column:
    """``count`` equal findings."""
    one = F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(path).alias("field_path"), F.lit(stage).alias("stage"))
    return F.array_repeat(one, F.coalesce(count, F.lit(0)).cast("int"))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _collected(singles: list[Column], lists: list[Column]) -> Column:
    return F.concat(F.array_compact(F.array(*singles)), *lists).cast(_ISSUE)


def match_issues(rows: DataFrame, now_us: int | None = None, allow_future: bool = False, tolerance: int = TOLERANCE_SECONDS) -> DataFrame:
    """``rows`` with issues. Needs scheduled_us, start_us, done_us (microseconds, null if unknown) beside the fields.

    ``now_us``: when the import runs; without it nothing is called future.
    """
    c = F.col
    sets = F.coalesce("sets", F.array().cast("array<struct<set_number:int,player_a_points:int,player_b_points:int>>"))
    scored = F.filter(sets, lambda s: s["player_a_points"].isNotNull() & s["player_b_points"].isNotNull())
    size = lambda keep: F.size(F.filter(sets, keep))
    numbers = F.filter(F.transform(sets, lambda s: s["set_number"]), lambda n: n.isNotNull())
    a = F.size(F.filter(scored, lambda s: s["player_a_points"] > s["player_b_points"]))
    b = F.size(scored) - a
    implied = F.when(a > b, c("player_a_external_id")).when(b > a, c("player_b_external_id"))
    winner = c("winner_external_id")
    among = (winner == c("player_a_external_id")) | (winner == c("player_b_external_id"))
    effective = F.coalesce("done_us", "start_us", "scheduled_us")
    slack = tolerance * 1_000_000
    singles = [
        _if(_blank("player_a_external_id"), "fatal", "missing_player_a", "player_a_external_id", "structural"),
        _if(_blank("player_b_external_id"), "fatal", "missing_player_b", "player_b_external_id", "structural"),
        _if(c("scheduled_us").isNull(), "error", "missing_scheduled_at", "scheduled_at", "structural"),
        _if(c("status_raw").isNull(), "error", "missing_status", "status_raw", "structural"),
        _if(c("status").isNull() & c("status_raw").isNotNull(), "warning", "unmapped_status", "status", "structural"),
        _if(c("status").isNotNull() & ~c("status").isin(*STATUSES), "fatal", "invalid_status", "status", "structural"),
        _if(c("best_of") < 1, "error", "invalid_best_of", "best_of", "structural"),
        _if(~_blank("player_a_external_id") & (c("player_a_external_id") == c("player_b_external_id")), "fatal", "same_player", "player_a_external_id", "semantic"),
        _if(winner.isNotNull() & ~F.coalesce(among, F.lit(False)), "fatal", "winner_not_participant", "winner_external_id", "semantic"),
        _if(c("status").isin(*COMPLETED) & winner.isNull(), "error", "completed_without_winner", "winner_external_id", "semantic"),
        _if((c("status") == "scheduled") & winner.isNotNull(), "error", "scheduled_with_winner", "winner_external_id", "semantic"),
        _if(winner.isNotNull() & implied.isNotNull() & (implied != winner), "error", "score_result_mismatch", "winner_external_id", "semantic"),
        _if(F.size(scored) > c("best_of"), "error", "sets_exceed_best_of", "sets", "semantic"),
        _if(c("done_us") < c("start_us"), "fatal", "completion_before_start", "completed_at", "temporal"),
        _if(F.unix_micros("provenance.source_timestamp") > F.unix_micros("provenance.ingested_at") + slack, "warning", "source_after_ingestion", "provenance.source_timestamp", "temporal"),
    ]
    if now_us is not None and not allow_future:
        singles.append(_if(effective > now_us + slack, "error", "future_historical_record", "scheduled_at", "temporal"))
    lists = [
        _each(size(lambda s: s["set_number"].isNull()), "error", "missing_set_number", "sets", "structural"),
        _each(F.size(sets) - F.size(scored), "error", "missing_set_score", "sets", "structural"),
        _each(F.size(F.filter(scored, lambda s: (s["player_a_points"] < 0) | (s["player_b_points"] < 0))), "fatal", "negative_set_score", "sets", "structural"),
        _each(F.size(numbers) - F.size(F.array_distinct(numbers)), "error", "duplicate_set_number", "sets", "semantic"),
    ]
    return rows.withColumn("issues", _collected(singles, lists))


def record_violations() -> Column:
    """What no stored match may be, as an array of codes, of rows with issues: checks that go beyond those of an import.

    set_tied, set_number_not_positive, scheduled_with_play (sets, start or completion), winner_before_end (live or
    cancelled with a winner), completion_before_schedule (without a start).
    """
    c = F.col
    sets = F.coalesce("sets", F.array().cast("array<struct<set_number:int,player_a_points:int,player_b_points:int>>"))
    code = lambda when, name: F.when(when, F.lit(name))
    return F.array_compact(F.array(
        code(F.exists(sets, lambda s: s["player_a_points"] == s["player_b_points"]), "set_tied"),
        code(F.exists(sets, lambda s: s["set_number"] < 1), "set_number_not_positive"),
        code((c("status") == "scheduled") & ((F.size(sets) > 0) | c("start_us").isNotNull() | c("done_us").isNotNull()), "scheduled_with_play"),
        code(c("status").isin("live", "cancelled") & c("winner_external_id").isNotNull(), "winner_before_end"),
        code(c("start_us").isNull() & (c("done_us") < c("scheduled_us")), "completion_before_schedule"),
    ))


def odds_issues(rows: DataFrame, now_us: int | None = None, allow_future: bool = False, tolerance: int = TOLERANCE_SECONDS) -> DataFrame:
    """``rows`` with issues. Needs captured_us, and match_effective_us (null: not known) beside the fields."""
    c = F.col
    slack = tolerance * 1_000_000
    singles = [
        _if(_blank("provider_match_id"), "fatal", "missing_match_id", "provider_match_id", "structural"),
        _if(_blank("bookmaker"), "fatal", "missing_bookmaker", "bookmaker", "structural"),
        _if(_blank("selection_external_id"), "fatal", "missing_selection", "selection_external_id", "structural"),
        _if(c("decimal_odds").isNull(), "fatal", "missing_odds", "decimal_odds", "structural"),
        _if(c("captured_us").isNull(), "error", "missing_captured_at", "captured_at", "structural"),
        _if(c("decimal_odds") <= 1.0, "fatal", "invalid_odds", "decimal_odds", "semantic"),
        _if(c("captured_us") > c("match_effective_us") + slack, "warning", "odds_after_match_lifecycle", "captured_at", "temporal"),
    ]
    if now_us is not None and not allow_future:
        singles.append(_if(c("captured_us") > now_us + slack, "error", "future_odds_timestamp", "captured_at", "temporal"))
    return rows.withColumn("issues", _collected(singles, []))


def outcome(issues: Column, strict: bool = True, warning: str = "accept") -> Column:
    """accept, warn or reject: fatal findings reject, errors if ``strict``; ``warning`` is what warnings do."""
    has = lambda s: F.exists(issues, lambda i: i["severity"] == s)
    return F.when(has("fatal"), "reject").when(has("error"), "reject" if strict else "warn").when(has("warning"), warning).otherwise("accept")


#: Which reason a rejected row is quarantined for: the first whose codes it has.
REASONS = (
    ("invalid_score", ("negative_set_score", "missing_set_score", "duplicate_set_number", "sets_exceed_best_of")),
    ("unsupported_status", ("invalid_status", "unmapped_status", "missing_status")),
    ("impossible_timestamps", ("completion_before_start", "future_historical_record", "future_odds_timestamp")),
    ("conflicting_result", ("score_result_mismatch", "winner_not_participant", "completed_without_winner", "scheduled_with_winner")),
)


def quarantine_reason(issues: Column) -> Column:
    codes = F.transform(issues, lambda i: i["code"])
    out = F.lit("missing_critical_field")
    for reason, of in reversed(REASONS):
        out = F.when(F.arrays_overlap(codes, F.array(*[F.lit(x) for x in of])), reason).otherwise(out)
    return out
