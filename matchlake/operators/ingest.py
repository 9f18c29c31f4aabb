"""From import rows to stored records: each row gets an outcome, and what is not stored gets a record of why.

A row is validated, its external ids are replaced by internal ones, and it is compared with what is stored under its
id and, for matches, with what another provider has near the same time. All of it is joins and aggregates on ids: no row
waits for another one's outcome. Rows of one import see each other in order of arrival, as if they came one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.columns import rate
from matchlake.operators import duplicates, validate

OUTCOMES = ("inserted", "merged_safe", "skipped_idempotent", "rejected_conflict", "quarantined")


def external_index(identities: DataFrame, players: DataFrame) -> DataFrame:
    """(provider, external_id, internal_id): who an external id stands for.

    ``identities``: id, external_ids; the smallest identity that lists an id has it. ``players``: provider, external_id of
    registrations; what no identity lists is a new player named after its provider and id. Null and blank ids are none.
    """
    listed = identities.select(F.col("id").alias("internal_id"), F.explode("external_ids").alias("x")).select("internal_id", F.col("x.provider").alias("provider"), F.col("x.provider_player_id").alias("external_id"))
    made = players.select(F.lit(None).cast("string").alias("internal_id"), "provider", "external_id")
    both = listed.unionByName(made).where(F.col("provider").isNotNull() & (F.length(F.trim("external_id")) > 0))
    new = F.concat_ws(":", F.lit("player"), "provider", "external_id")
    return both.groupBy("provider", "external_id").agg(F.min("internal_id").alias("internal_id")).withColumn("internal_id", F.coalesce("internal_id", new))


def _resolved(rows: DataFrame, index: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``rows`` with the internal id of each external one; ``fields``: new column, column of the external id."""
    for name, column in fields.items():
        i = index.select(F.col("provider").alias("__p"), F.col("external_id").alias("__e"), F.col("internal_id").alias(name))
        rows = rows.join(i, (rows["provenance.provider"] == i["__p"]) & (rows[column] == i["__e"]), "left").drop("__p", "__e")
    return rows


def _record_id() -> Column:
    record = F.col("provenance.provider_record_id")
    return F.when(F.length(F.trim(record)) > 0, F.concat_ws(":", "provenance.provider", record))


def _results(df: DataFrame, table_name: str, row_id: str) -> DataFrame:
    return df.select(F.lit(table_name).alias("table_name"), F.col(row_id).cast("bigint").alias("row_id"), F.col("provenance.provider").alias("provider"), F.col("provenance.provider_record_id").alias("provider_record_id"), "internal_id", "outcome", "reason", "detail")


def match_results(rows: DataFrame, index: DataFrame, stored: DataFrame | None = None, strict: bool = True, seconds: int = duplicates.WINDOW_SECONDS) -> DataFrame:
    """``rows`` of import matches with internal_id, a_id, b_id, winner, outcome, reason and detail.

    ``rows``: as ``validate.match_issues`` returns them, with match_row_id; ``index``: ``external_index``; ``stored``: id,
    provider, player_a, player_b, winner, scheduled_us, status, sets of what is there. Quarantined, with the reason: what
    validation rejects or no record may hold, an unknown status, a missing record id, players that are not known yet, and
    a new match that another provider has within ``seconds`` (detail names it), whether that one is stored or came earlier.
    """
    rows = _resolved(rows, index, {"a_id": "player_a_external_id", "b_id": "player_b_external_id"}).withColumn("internal_id", _record_id())
    rows = rows.withColumn("winner", F.when(F.col("winner_external_id") == F.col("player_a_external_id"), F.col("a_id")).when(F.col("winner_external_id").isNotNull(), F.col("b_id")))
    bad = (
        F.when(validate.outcome(F.col("issues"), strict) == "reject", validate.quarantine_reason(F.col("issues")))
        .when(F.col("status").isNull(), "unsupported_status")
        .when(F.size(validate.record_violations()) > 0, "invalid_record")
        .when(F.col("internal_id").isNull() | F.col("a_id").isNull() | F.col("b_id").isNull(), "missing_critical_field")
    )
    rows = rows.withColumn("__bad", bad)
    arrived = F.col("provenance.ingested_at")
    good = rows.where("__bad is null").select(F.col("internal_id").alias("id"), "winner", "scheduled_us", "status", "sets", arrived.alias("arrived"), F.col("match_row_id").alias("row_id"), F.col("provenance.provider").alias("provider"), F.col("a_id").alias("player_a"), F.col("b_id").alias("player_b"))
    there = (good.drop("arrived", "row_id").limit(0) if stored is None else stored).select("id", "winner", "scheduled_us", "status", "sets", "provider", "player_a", "player_b")
    decided = duplicates.match_outcomes(good, there.select("id", *duplicates.CONTENT))
    new = decided.where("outcome = 'inserted'").select("id", "provider", "player_a", "player_b", "scheduled_us", "arrived", "row_id")
    old = there.select("id", "provider", "player_a", "player_b", "scheduled_us", F.lit(None).cast(new.schema["arrived"].dataType).alias("arrived"), F.lit(None).cast("bigint").alias("row_id"))
    twins = duplicates.cross_provider(new, seconds, old.unionByName(new)).select(F.col("id").alias("__id"), "duplicate_of")
    decided = decided.select("row_id", "id", "outcome", "reason").join(twins, (F.col("id") == F.col("__id")) & (F.col("outcome") == "inserted"), "left")
    twin = F.col("duplicate_of").isNotNull()
    decided = decided.select(F.col("row_id").alias("__row"), F.when(twin, "quarantined").otherwise(F.col("outcome")).alias("outcome"), F.when(twin, "duplicate_conflict").otherwise(F.col("reason")).alias("reason"), F.col("duplicate_of").alias("detail"))
    out = rows.join(decided, F.col("match_row_id") == F.col("__row"), "left").drop("__row")
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("quarantined"))).withColumn("reason", F.coalesce("__bad", "reason")).drop("__bad")


def odds_results(rows: DataFrame, index: DataFrame, stored: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """``rows`` of import odds with internal_id, selection, outcome, reason and detail.

    ``rows``: as ``validate.odds_issues`` returns them, with odds_row_id and captured_us; ``stored``: id, decimal_odds. The
    match that a quote names need not be there. An id is made of provider, match, bookmaker, selection and instant.
    """
    rows = _resolved(rows, index, {"selection": "selection_external_id"})
    key = F.concat_ws(":", "provenance.provider", "provider_match_id", "bookmaker", "selection", F.col("captured_us").cast("string"))
    bad = F.when(validate.outcome(F.col("issues"), strict) == "reject", validate.quarantine_reason(F.col("issues"))).when(F.col("selection").isNull(), "missing_critical_field")
    rows = rows.withColumn("__bad", bad).withColumn("internal_id", F.when(F.col("__bad").isNull(), key))
    good = rows.where("__bad is null").select(F.col("internal_id").alias("id"), "decimal_odds", F.col("provenance.ingested_at").alias("arrived"), F.col("odds_row_id").alias("row_id"))
    there = good.select("id", "decimal_odds").limit(0) if stored is None else stored.select("id", "decimal_odds")
    decided = duplicates.odds_outcomes(good, there).select(F.col("row_id").alias("__row"), "outcome")
    out = rows.join(decided, F.col("odds_row_id") == F.col("__row"), "left").drop("__row")
    out = out.withColumn("outcome", F.coalesce("outcome", F.lit("quarantined"))).withColumn("reason", F.coalesce("__bad", F.when(F.col("outcome") == "rejected_conflict", F.lit("decimal_odds"))))
    return out.withColumn("detail", F.lit(None).cast("string")).drop("__bad")


def results(matches: DataFrame, odds: DataFrame) -> DataFrame:
    """(table_name, row_id, provider, provider_record_id, internal_id, outcome, reason, detail) of both."""
    return _results(matches, "imported_match", "match_row_id").unionByName(_results(odds, "imported_odds", "odds_row_id"))


def quarantine(of: DataFrame) -> DataFrame:
    """(id, record_type, provider, provider_record_id, reason, detail, row_id): one record for each message that was set
    aside, of its last row; ``of``: ``results``."""
    kind = F.regexp_replace("table_name", "^imported_", "")
    rows = of.where("outcome = 'quarantined'").select(F.concat_ws(":", F.lit("quarantine"), kind, "provider", F.coalesce("provider_record_id", F.concat(F.lit("row "), "row_id"))).alias("id"), kind.alias("record_type"), "provider", "provider_record_id", "reason", "detail", "row_id")
    last = rows.groupBy("id").agg(F.max_by(F.struct("record_type", "provider", "provider_record_id", "reason", "detail", "row_id"), "row_id").alias("r"))
    return last.select("id", "r.*")


def conflicts(of: DataFrame) -> DataFrame:
    """(id, record_type, internal_id, provider, provider_record_id, conflicting_field, row_id), as ``quarantine``."""
    kind = F.regexp_replace("table_name", "^imported_", "")
    rows = of.where("outcome = 'rejected_conflict'").select(F.concat_ws(":", F.lit("conflict"), kind, "provider", "provider_record_id").alias("id"), kind.alias("record_type"), "internal_id", "provider", "provider_record_id", F.col("reason").alias("conflicting_field"), "row_id")
    last = rows.groupBy("id").agg(F.max_by(F.struct("record_type", "internal_id", "provider", "provider_record_id", "conflicting_field", "row_id"), "row_id").alias("r"))
    return last.select("id", "r.*")


def report(of: DataFrame, issues: DataFrame, by: str = "provider") -> DataFrame:
    """Counts and rates of each ``by`` and, with a null there, of all: rates are means weighted by the rows read.

    ``of``: ``results``; ``issues``: ``by`` and severity, a row for each finding. Validity counts findings, not rows, so it
    can be negative; both validities are one formula.
    """
    count = lambda *which: F.count_if(F.col("outcome").isin(*which))
    each = of.groupBy(by).agg(
        F.count("*").alias("read"), count("inserted", "merged_safe", "skipped_idempotent").alias("accepted"), count("inserted", "merged_safe").alias("inserted"),
        count("skipped_idempotent").alias("skipped"), count("quarantined").alias("quarantined"), count("rejected_conflict").alias("rejected"),
    )
    severe = issues.groupBy(F.col(by).alias("__by")).agg(F.count_if(F.col("severity").isin("fatal", "error")).alias("severe"))
    each = each.join(severe, F.col(by).eqNullSafe(F.col("__by")), "left").withColumn("severe", F.coalesce("severe", F.lit(0))).drop("__by")
    sums = [c for c in each.columns if c != by]
    all_ = each.agg(*[F.sum(c).alias(c) for c in sums]).where("read is not null").select(F.lit(None).cast(of.schema[by].dataType).alias(by), *sums)
    rates = {"structural_validity_rate": 1 - rate(F.col("severe"), F.col("read")), "semantic_validity_rate": 1 - rate(F.col("severe"), F.col("read"))}
    rates |= {n: rate(F.col(c), F.col("read")) for n, c in (("ambiguity_rate", "quarantined"), ("exact_duplicate_rate", "skipped"), ("conflict_rate", "rejected"), ("accepted_record_rate", "accepted"))}
    return each.unionByName(all_).select(by, *sums, *[c.alias(n) for n, c in rates.items()])
