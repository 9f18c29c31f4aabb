"""Import queries: mapping raw messages, validating, classifying repeats; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions.columns import canonical_json, payload_fingerprint
from matchlake.operators import adapt, duplicates, ingest, timestamps, validate
from matchlake.plans import problems
from matchlake.session import cut_lineage, table

#: When the import is taken to run, in the queries that ask what is in the future.
NOW_US = 1_750_000_000_000_000
#: What arrived before is stored already, in the queries that compare with stored rows.
STORED_BEFORE = "2025-01-01 00:00:00+00:00"


def mapping(provider: str) -> adapt.ProviderMapping:
    """The mapping of the example providers: they share field names and status words."""
    return adapt.ProviderMapping(
        provider,
        {
            "player": {"name": "name", "country": "country", "ranking_hint": "ranking_hint"},
            "match": {
                "competition_id": "competition_id", "competition_name": "competition_name", "player_a_external_id": "player_a_id", "player_b_external_id": "player_b_id", "scheduled_at": "scheduled_at",
                "actual_start_at": "actual_start_at", "completed_at": "completed_at", "status": "status", "best_of": "best_of", "winner_external_id": "winner_id",
            },
            "odds": {"provider_match_id": "match_id", "bookmaker": "bookmaker", "selection_external_id": "selection_id", "decimal_odds": "decimal_odds", "captured_at": "captured_at", "market_id": "market_id"},
            "competition": {"name": "name", "country": "country", "level": "level", "format": "format", "season": "season", "indoor": "indoor", "active_from": "active_from", "active_to": "active_to"},
            "ranking": {"player_external_id": "player_id", "ranking": "ranking", "ranking_points": "ranking_points", "effective_at": "effective_at"},
        },
        {"FT": "finished", "finished": "finished", "COMPLETED": "finished", "SCHEDULED": "scheduled", "upcoming": "scheduled", "LIVE": "live", "RETIRED": "retired", "CANCELLED": "cancelled"},
        version="1.0.0",
    )


def registry(spark: SparkSession, sf: str) -> adapt.Registry:
    """The providers of provider_feed, a table of a row for each source."""
    return adapt.Registry(*[mapping(r.provider) for r in table(spark, sf, "provider_feed").select("provider").where("provider is not null").collect()])


def _adapted(spark: SparkSession, sf: str, record_type: str) -> DataFrame:
    return adapt.adapt_all(table(spark, sf, "raw_record"), record_type, registry(spark, sf))[0]


def adapt_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each provider's messages of each type: mapped, rejected by the mapping, or covered by none."""
    raw, known = table(spark, sf, "raw_record"), registry(spark, sf)
    out = adapt.unmapped(raw, known.mappings()).select("provider", "record_type", F.lit("unmapped").alias("fate"))
    for kind in adapt.RECORD_TYPES:
        rows, rejected = adapt.adapt_all(raw, kind, known)
        out = out.unionByName(rows.select(F.col("provenance.provider").alias("provider"), F.lit(kind).alias("record_type"), F.lit("mapped").alias("fate")))
        out = out.unionByName(rejected.select("provider", "record_type", F.lit("rejected").alias("fate")))
    return out.groupBy("provider", "record_type", "fate").agg(F.count("*").alias("messages"))


def _source(*fields: str) -> list[Column]:
    return [F.col("provenance.provider").alias("provider"), F.col("provenance.provider_record_id").alias("provider_record_id"), F.col("provenance.source_batch_id").alias("source_batch_id"), *[F.col(f) for f in fields]]


def adapt_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = _adapted(spark, sf, "match")
    points = lambda x: F.aggregate("sets", F.lit(0).cast("bigint"), lambda t, s: t + F.coalesce(s[x], F.lit(0)))
    return rows.select(
        *_source("competition_id", "player_a_external_id", "player_b_external_id", "status_raw", "status", "best_of", "winner_external_id"),
        F.unix_micros("scheduled_at").alias("scheduled_us"), F.unix_micros("completed_at").alias("completed_us"),
        F.size("sets").cast("bigint").alias("set_count"), points("player_a_points").alias("points_a"), points("player_b_points").alias("points_b"), F.size("provenance.warnings").cast("bigint").alias("warnings"),
    )


def adapt_odds(spark: SparkSession, sf: str) -> DataFrame:
    return _adapted(spark, sf, "odds").select(*_source("provider_match_id", "bookmaker", "selection_external_id", "decimal_odds", "market_id"), F.unix_micros("captured_at").alias("captured_us"))


def adapt_players(spark: SparkSession, sf: str) -> DataFrame:
    return _adapted(spark, sf, "player").select(*_source("name", "country", "ranking_hint", "external_player_id"))


def adapt_rankings(spark: SparkSession, sf: str) -> DataFrame:
    return _adapted(spark, sf, "ranking").select(*_source("player_external_id", "ranking", "ranking_points"), F.unix_micros("effective_at").alias("effective_us"))


def adapt_competitions(spark: SparkSession, sf: str) -> DataFrame:
    return _adapted(spark, sf, "competition").select(*_source("name", "country", "level", "season", "indoor"))


def payload_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Messages whose deliveries carry different payloads."""
    raw = table(spark, sf, "raw_record").select("provider", "record_type", F.lower(F.trim("provider_record_id")).alias("record"), payload_fingerprint("payload").alias("f"), canonical_json("payload").alias("j"))
    return raw.groupBy("provider", "record_type", "record").agg(F.countDistinct("f").alias("versions"), F.countDistinct("j").alias("texts")).where("versions > 1")


def instants(spark: SparkSession, sf: str, rows: DataFrame, **fields: str) -> DataFrame:
    """``rows`` with the instants that texts in any form denote; ``fields``: name of the instant, column of the text."""
    zones = cut_lineage(timestamps.source_zones(table(spark, sf, "provider_feed")))  # read for each field
    for out, text in fields.items():
        rows = timestamps.with_instants(rows, text, "provenance.provider", zones, out)
    return rows


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "imported_match").withColumn("start_us", F.unix_micros("actual_start_at"))
    return instants(spark, sf, rows, scheduled_us="scheduled_at", done_us="completed_at")


def _odds(spark: SparkSession, sf: str) -> DataFrame:
    """Odds with the effective time of the first delivered match of that key at the provider."""
    m = _matches(spark, sf).where("provenance.provider_record_id is not null")
    first = m.groupBy(F.col("provenance.provider").alias("__p"), F.col("provenance.provider_record_id").alias("__k")).agg(F.min(F.struct(F.col("match_row_id"), F.coalesce("done_us", "start_us", "scheduled_us").alias("e"))).alias("f"))
    o = instants(spark, sf, table(spark, sf, "imported_odds"), captured_us="captured_at")
    return o.join(first, (F.col("provenance.provider") == F.col("__p")) & (F.col("provider_match_id") == F.col("__k")), "left").withColumn("match_effective_us", F.col("f.e")).drop("__p", "__k", "f")


def validate_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = validate.match_issues(_matches(spark, sf), NOW_US).select("match_row_id", F.inline("issues"))
    return rows.groupBy("match_row_id", "severity", "code", "field_path", "stage").agg(F.count("*").alias("issues"))


def validate_odds(spark: SparkSession, sf: str) -> DataFrame:
    return validate.odds_issues(_odds(spark, sf), NOW_US).select("odds_row_id", F.inline("issues"))


def validation_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per provider, decision and reason of quarantine."""
    rows = validate.match_issues(_matches(spark, sf), NOW_US).withColumn("outcome", validate.outcome(F.col("issues")))
    reason = F.when(F.col("outcome") == "reject", validate.quarantine_reason(F.col("issues")))
    return rows.groupBy(F.col("provenance.provider").alias("provider"), "outcome", reason.alias("reason")).agg(F.count("*").alias("match_rows"))


def severity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return validate_matches(spark, sf).groupBy("severity").agg(F.sum("issues").alias("issues"))


def dedupe_matches(spark: SparkSession, sf: str) -> DataFrame:
    staged = _matches(spark, sf).where("provenance.provider_record_id is not null").select(
        F.concat_ws(":", "provenance.provider", "provenance.provider_record_id").alias("id"), F.col("winner_external_id").alias("winner"), "scheduled_us", "status", "sets",
        F.col("provenance.ingested_at").alias("arrived"), F.col("match_row_id").alias("row_id"),
    )
    return duplicates.match_outcomes(staged, staged.drop("arrived", "row_id").limit(0)).select(F.col("row_id").alias("match_row_id"), "outcome", "reason")


def dedupe_odds(spark: SparkSession, sf: str) -> DataFrame:
    rows = instants(spark, sf, table(spark, sf, "imported_odds"), captured_us="captured_at")
    captured = F.coalesce(F.col("captured_us").cast("string"), F.col("captured_at"))  # one instant in two forms is one quote
    key = F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in (F.col("provenance.provider"), F.col("provider_match_id"), F.lower(F.trim("bookmaker")), F.col("selection_external_id"), captured)])
    staged = rows.select(key.alias("id"), "decimal_odds", F.col("provenance.ingested_at").alias("arrived"), F.col("odds_row_id").alias("row_id"))
    return duplicates.odds_outcomes(staged, staged.select("id", "decimal_odds").limit(0)).select(F.col("row_id").alias("odds_row_id"), "outcome")


def dedupe_stored_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that arrive after those stored before: what each is to the stored one, or to an earlier one of the rest."""
    rows = _matches(spark, sf).where("provenance.provider_record_id is not null")
    old = F.coalesce(F.col("provenance.ingested_at") < F.lit(STORED_BEFORE).cast("timestamp"), F.lit(False))
    all_ = rows.select(
        F.concat_ws(":", "provenance.provider", "provenance.provider_record_id").alias("id"), F.col("winner_external_id").alias("winner"), "scheduled_us", "status", "sets",
        F.col("provenance.ingested_at").alias("arrived"), F.col("match_row_id").alias("row_id"), old.alias("old"),
    )
    stored = all_.where("old").groupBy("id").agg(F.min_by(F.struct(*duplicates.CONTENT), F.struct("arrived", "row_id")).alias("s")).select("id", "s.*")
    return duplicates.match_outcomes(all_.where("not old").drop("old"), stored).select(F.col("row_id").alias("match_row_id"), "outcome", "reason")


def match_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that no stored match may be like, per provider and constraint."""
    rows = _matches(spark, sf).select(F.col("provenance.provider").alias("provider"), F.explode(validate.record_violations()).alias("code"))
    return rows.groupBy("provider", "code").agg(F.count("*").alias("match_rows"))


def external_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Who each external id stands for."""
    players = table(spark, sf, "imported_player").select(F.col("provenance.provider").alias("provider"), F.col("external_player_id").alias("external_id"))
    return ingest.external_index(table(spark, sf, "player_identity"), players)


def _imported(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    index = external_ids(spark, sf)
    matches = ingest.match_results(validate.match_issues(_matches(spark, sf), NOW_US), index)
    odds = instants(spark, sf, table(spark, sf, "imported_odds"), captured_us="captured_at").withColumn("match_effective_us", F.lit(None).cast("bigint"))
    return matches, ingest.odds_results(validate.odds_issues(odds, NOW_US), index)


def import_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each match and quote of an import: its outcome, why, and the id it is stored under."""
    return ingest.results(*_imported(spark, sf)).select("table_name", "row_id", "internal_id", "outcome", "reason", "detail")


def import_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.quarantine(ingest.results(*_imported(spark, sf)))


def import_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.conflicts(ingest.results(*_imported(spark, sf)))


def import_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and rates of the import per provider, and of all (a null provider)."""
    matches, odds = _imported(spark, sf)
    found = lambda df: df.select(F.col("provenance.provider").alias("provider"), F.inline("issues")).select("provider", "severity")
    return ingest.report(ingest.results(matches, odds), found(matches).unionByName(found(odds)))


def historical_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The matches that the import stores, with internal ids; sets that lack a number or a score are left out."""
    rows = _imported(spark, sf)[0].where("outcome = 'inserted'")
    whole = F.filter(F.coalesce("sets", F.array().cast("array<struct<set_number:int,player_a_points:int,player_b_points:int>>")), lambda s: s["set_number"].isNotNull() & s["player_a_points"].isNotNull() & s["player_b_points"].isNotNull())
    return rows.select(
        F.col("internal_id").alias("id"), F.col("provenance.provider").alias("provider"), "competition_id", F.col("a_id").alias("player_a_id"), F.col("b_id").alias("player_b_id"), "scheduled_us", "start_us", "done_us",
        "status", "best_of", F.col("winner").alias("winner_id"), F.size(whole).cast("bigint").alias("sets"), F.unix_micros("provenance.ingested_at").alias("ingested_us"),
    )


def cross_provider_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of one customer pair read as matches of two providers; near in time means the same day."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("provider"),
        (F.col("o_custkey") % 10).alias("player_a"), (F.col("o_orderkey") % 7 + 10).alias("player_b"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("scheduled_us"),
    )
    return duplicates.cross_provider(orders, 86_400)


def import_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per provider: rows read, outcomes, and rates of them."""
    rows = dedupe_matches(spark, sf).join(table(spark, sf, "imported_match").select("match_row_id", F.col("provenance.provider").alias("provider")), "match_row_id")
    is_ = lambda o: F.sum((F.col("outcome") == o).cast("bigint"))
    out = rows.groupBy("provider").agg(F.count("*").alias("records"), is_("inserted").alias("inserted"), is_("merged_safe").alias("merged"), is_("skipped_idempotent").alias("skipped"), is_("rejected_conflict").alias("conflicts"))
    return out.withColumn("accepted", F.col("inserted") + F.col("merged") + F.col("skipped")).withColumn("duplicate_rate", F.col("skipped") / F.col("records")).withColumn("conflict_rate", F.col("conflicts") / F.col("records"))


QUERIES = {
    f.__name__: f
    for f in (
        adapt_matches, adapt_odds, adapt_players, adapt_rankings, adapt_competitions, payload_fingerprints, validate_matches, validate_odds, validation_outcomes,
        severity_histogram, dedupe_matches, dedupe_stored_matches, dedupe_odds, cross_provider_duplicates, import_metrics,
        adapt_accounting, match_constraints, external_ids, import_outcomes, import_quarantine, import_conflicts, import_report, historical_matches,
    )
}

_SRC = "provider, provider_record_id, source_batch_id"
_J = lambda k: f"payload->>'{k}'"
_TS = lambda k: f"epoch_us(try_cast(payload->>'{k}' as timestamptz))"
_WORDS = "case payload->>'status' " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping("x").statuses.items()) + " end"
# The instants that the texts of either table denote, in whatever form, as the SQL of problem 3 reads them.
_T = f"""{problems._P3.strip()}, tm as (select table_name tn, field_name fn, row_id ri, coalesce(us, epoch_us(first_pass)) i from r)"""
_M = f"""{_T}, m as (select im.*, provenance.provider pv, provenance.provider_record_id rid, s.i su, epoch_us(actual_start_at) st, c.i du,
  list_filter(coalesce(sets, []), lambda s: s.player_a_points is not null and s.player_b_points is not null) sc, list_filter(list_transform(coalesce(sets, []), lambda s: s.set_number), lambda x: x is not null) nums
  from imported_match im left join tm s on s.tn = 'imported_match' and s.fn = 'scheduled_at' and s.ri = match_row_id left join tm c on c.tn = 'imported_match' and c.fn = 'completed_at' and c.ri = match_row_id)"""
_RULES = [
    ("coalesce(player_a_external_id, '') = ''", 1, "fatal", "missing_player_a", "player_a_external_id", "structural"),
    ("coalesce(player_b_external_id, '') = ''", 1, "fatal", "missing_player_b", "player_b_external_id", "structural"),
    ("su is null", 1, "error", "missing_scheduled_at", "scheduled_at", "structural"),
    ("status_raw is null", 1, "error", "missing_status", "status_raw", "structural"),
    ("status is null and status_raw is not null", 1, "warning", "unmapped_status", "status", "structural"),
    ("status not in ('scheduled', 'live', 'finished', 'retired', 'cancelled')", 1, "fatal", "invalid_status", "status", "structural"),
    ("best_of < 1", 1, "error", "invalid_best_of", "best_of", "structural"),
    ("player_a_external_id <> '' and player_a_external_id = player_b_external_id", 1, "fatal", "same_player", "player_a_external_id", "semantic"),
    ("winner_external_id is not null and not coalesce(winner_external_id = player_a_external_id or winner_external_id = player_b_external_id, false)", 1, "fatal", "winner_not_participant", "winner_external_id", "semantic"),
    ("status in ('finished', 'retired') and winner_external_id is null", 1, "error", "completed_without_winner", "winner_external_id", "semantic"),
    ("status = 'scheduled' and winner_external_id is not null", 1, "error", "scheduled_with_winner", "winner_external_id", "semantic"),
    ("winner_external_id is not null and case when wa * 2 > len(sc) then player_a_external_id when wa * 2 < len(sc) then player_b_external_id end <> winner_external_id", 1, "error", "score_result_mismatch", "winner_external_id", "semantic"),
    ("len(sc) > best_of", 1, "error", "sets_exceed_best_of", "sets", "semantic"),
    ("du < st", 1, "fatal", "completion_before_start", "completed_at", "temporal"),
    ("epoch_us(provenance.source_timestamp) > epoch_us(provenance.ingested_at) + 60000000", 1, "warning", "source_after_ingestion", "provenance.source_timestamp", "temporal"),
    (f"coalesce(du, st, su) > {NOW_US} + 60000000", 1, "error", "future_historical_record", "scheduled_at", "temporal"),
    ("len(sets) > len(nums)", "len(sets) - len(nums)", "error", "missing_set_number", "sets", "structural"),
    ("len(sets) > len(sc)", "len(sets) - len(sc)", "error", "missing_set_score", "sets", "structural"),
    ("neg > 0", "neg", "fatal", "negative_set_score", "sets", "structural"),
    ("len(nums) > len(list_distinct(nums))", "len(nums) - len(list_distinct(nums))", "error", "duplicate_set_number", "sets", "semantic"),
]
_V = (
    f"{_M}, m2 as (select *, len(list_filter(sc, lambda s: s.player_a_points > s.player_b_points)) wa, len(list_filter(sc, lambda s: s.player_a_points < 0 or s.player_b_points < 0)) neg from m), v as ("
    + " union all ".join(f"select match_row_id, '{s}' severity, '{code}' code, '{path}' field_path, '{stage}' stage, ({n})::bigint issues from m2 where {cond}" for cond, n, s, code, path, stage in _RULES)
    + ")"
)
_REASON = " ".join(f"when bool_or(code in ({', '.join(repr(x) for x in of)})) then '{r}'" for r, of in validate.REASONS)
_DD = f"""{_M}, d as (select pv || ':' || rid id, match_row_id, provenance.ingested_at t, {{'w': winner_external_id, 's': su, 'st': status, 'x': list_sort(coalesce(sets, []))}} c, row_number() over (partition by pv, rid order by provenance.ingested_at, match_row_id) rn from m where rid is not null),
f1 as (select id, c from d where rn = 1), f2 as (select id, min(rn) rn2, arg_min(c, rn) c2 from d where c.st <> 'scheduled' group by id),
e as (select d.*, case when d.rn = 1 then null when f1.c.st = 'scheduled' and f2.rn2 < d.rn then f2.c2 else f1.c end b from d join f1 using (id) left join f2 using (id)),
g as (select match_row_id, case when rn = 1 then 'inserted' when b is not distinct from c then 'skipped_idempotent' when b.st = 'scheduled' and c.st <> 'scheduled' then 'merged_safe' else 'rejected_conflict' end outcome,
  case when b.w is distinct from c.w then 'winner' when b.s is distinct from c.s then 'scheduled_at' else 'set scores' end r from e)"""
_CODE = lambda cond, sev, code, path, stage: f"case when {cond} then {{{{'severity': '{sev}', 'code': '{code}', 'field_path': '{path}', 'stage': '{stage}'}}}} end"
_OV = (
    "o as (select i.*, tm.i cu, {e} e from imported_odds i left join tm on tn = 'imported_odds' and ri = odds_row_id {join}), vo as (select odds_row_id, u.* from o, unnest(["
    + ", ".join(
        _CODE(*x)
        for x in (
            ("coalesce(provider_match_id, '') = ''", "fatal", "missing_match_id", "provider_match_id", "structural"),
            ("coalesce(bookmaker, '') = ''", "fatal", "missing_bookmaker", "bookmaker", "structural"),
            ("coalesce(selection_external_id, '') = ''", "fatal", "missing_selection", "selection_external_id", "structural"),
            ("decimal_odds is null", "fatal", "missing_odds", "decimal_odds", "structural"),
            ("cu is null", "error", "missing_captured_at", "captured_at", "structural"),
            ("decimal_odds <= 1", "fatal", "invalid_odds", "decimal_odds", "semantic"),
            ("cu > e + 60000000", "warning", "odds_after_match_lifecycle", "captured_at", "temporal"),
            (f"cu > {NOW_US} + 60000000", "error", "future_odds_timestamp", "captured_at", "temporal"),
        )
    )
    + "]) w(u) where u is not null)"
)
# A whole import: external ids replaced, rows that may not be stored set aside, the rest compared in order of arrival.
_VIOLATIONS = {
    "set_tied": "len(list_filter(coalesce(sets, []), lambda s: s.player_a_points = s.player_b_points)) > 0",
    "set_number_not_positive": "len(list_filter(coalesce(sets, []), lambda s: s.set_number < 1)) > 0",
    "scheduled_with_play": "status = 'scheduled' and (len(coalesce(sets, [])) > 0 or st is not null or du is not null)",
    "winner_before_end": "status in ('live', 'cancelled') and winner_external_id is not null",
    "completion_before_schedule": "st is null and du < su",
}
_IX = """ix as (select provider, external_id, coalesce(min(iid), 'player:' || provider || ':' || external_id) internal_id from (
    select id iid, u.x.provider provider, u.x.provider_player_id external_id from player_identity, unnest(external_ids) u(x)
    union all select null, provenance.provider, external_player_id from imported_player) where provider is not null and trim(external_id) <> '' group by provider, external_id)"""
_IM = f"""{_V}, {_IX}, rj as (select match_row_id, bool_or(severity in ('fatal', 'error')) rej, case {_REASON} else 'missing_critical_field' end why from v group by 1),
mm as (select m.*, a.internal_id a_id, b.internal_id b_id, case when winner_external_id = player_a_external_id then a.internal_id when winner_external_id is not null then b.internal_id end win, case when trim(rid) <> '' then pv || ':' || rid end iid,
  case when rej then why when status is null then 'unsupported_status' when {" or ".join(f"({x})" for x in _VIOLATIONS.values())} then 'invalid_record' when coalesce(trim(rid), '') = '' or a.internal_id is null or b.internal_id is null then 'missing_critical_field' end bad
  from m left join rj using (match_row_id) left join ix a on a.provider = pv and a.external_id = player_a_external_id left join ix b on b.provider = pv and b.external_id = player_b_external_id),
gd as (select iid id, match_row_id, pv, a_id, b_id, su, provenance.ingested_at t, {{'w': win, 's': su, 'st': status, 'x': list_sort(coalesce(sets, []))}} c, row_number() over (partition by iid order by provenance.ingested_at, match_row_id) rn from mm where bad is null),
g1 as (select id, c from gd where rn = 1), g2 as (select id, min(rn) rn2, arg_min(c, rn) c2 from gd where c.st <> 'scheduled' group by id),
ge as (select gd.*, case when gd.rn = 1 then null when g1.c.st = 'scheduled' and g2.rn2 < gd.rn then g2.c2 else g1.c end b from gd join g1 using (id) left join g2 using (id)),
gf as (select *, case when rn = 1 then 'inserted' when b is not distinct from c then 'skipped_idempotent' when b.st = 'scheduled' and c.st <> 'scheduled' then 'merged_safe' else 'rejected_conflict' end oc,
  case when b.w is distinct from c.w then 'winner' when b.s is distinct from c.s then 'scheduled_at' else 'set scores' end df from ge),
nw as (select * from gf where oc = 'inserted'),
tw as (select x.id, arg_min(y.id, {{'t': y.su, 'i': y.id}}) twin from nw x join nw y on least(x.a_id, x.b_id) = least(y.a_id, y.b_id) and greatest(x.a_id, x.b_id) = greatest(y.a_id, y.b_id) and x.pv <> y.pv and abs(x.su - y.su) <= 300000000 and (y.t, y.match_row_id) < (x.t, x.match_row_id) group by 1),
mr as (select mm.*, case when gf.id is null then 'quarantined' when oc = 'inserted' and twin is not null then 'quarantined' else oc end outcome,
  coalesce(bad, case when oc = 'inserted' and twin is not null then 'duplicate_conflict' when oc = 'rejected_conflict' then df end) reason, case when oc = 'inserted' then twin end detail from mm left join gf using (match_row_id) left join tw on tw.id = gf.id),
{_OV.format(e="null::bigint", join="")},
oj as (select odds_row_id, bool_or(severity in ('fatal', 'error')) rej, case {_REASON} else 'missing_critical_field' end why from vo group by 1),
om as (select o.*, ix.internal_id sel, case when rej then why when ix.internal_id is null then 'missing_critical_field' end bad from o left join oj using (odds_row_id) left join ix on ix.provider = provenance.provider and ix.external_id = selection_external_id),
og as (select odds_row_id, concat_ws(':', provenance.provider, provider_match_id, bookmaker, sel, cu::varchar) id, decimal_odds, first_value(decimal_odds) over w f, row_number() over w rn from om where bad is null
  window w as (partition by concat_ws(':', provenance.provider, provider_match_id, bookmaker, sel, cu::varchar) order by provenance.ingested_at, odds_row_id)),
orr as (select om.*, og.id iid, case when og.id is null then 'quarantined' when rn = 1 then 'inserted' when f is not distinct from og.decimal_odds then 'skipped_idempotent' else 'rejected_conflict' end outcome,
  coalesce(bad, case when rn > 1 and f is distinct from og.decimal_odds then 'decimal_odds' end) reason from om left join og using (odds_row_id)),
res as (select 'imported_match' table_name, match_row_id row_id, pv provider, rid provider_record_id, iid internal_id, outcome, reason, detail from mr
  union all select 'imported_odds', odds_row_id, provenance.provider, provenance.provider_record_id, iid, outcome, reason, null from orr)"""
_REP = """count(*)::bigint "read", (count(*) filter (outcome in ('inserted', 'merged_safe', 'skipped_idempotent')))::bigint accepted, (count(*) filter (outcome in ('inserted', 'merged_safe')))::bigint inserted,
    (count(*) filter (outcome = 'skipped_idempotent'))::bigint skipped, (count(*) filter (outcome = 'quarantined'))::bigint quarantined, (count(*) filter (outcome = 'rejected_conflict'))::bigint rejected"""
ORACLE = {
    "adapt_accounting": """with a as (select provider, record_type, case when provider not in (select provider from provider_feed) or record_type not in ('player', 'match', 'odds', 'competition', 'ranking') then 'unmapped'
        when json_valid(payload) and json_type(payload) = 'OBJECT' then 'mapped' else 'rejected' end fate from raw_record) select provider, record_type, fate, count(*)::bigint messages from a group by all""",
    "match_constraints": f"{_M}, x as (" + " union all ".join(f"select pv provider, '{k}' code from m where {c}" for k, c in _VIOLATIONS.items()) + ") select provider, code, count(*)::bigint match_rows from x group by all",
    "external_ids": f"with {_IX} select * from ix",
    "import_outcomes": f"{_IM} select table_name, row_id, internal_id, outcome, reason, detail from res",
    "import_quarantine": f"""{_IM}, q as (select concat_ws(':', 'quarantine', table_name[10:], provider, coalesce(provider_record_id, 'row ' || row_id)) id, table_name[10:] record_type, provider, provider_record_id, reason, detail, row_id from res where outcome = 'quarantined')
        select * from q qualify row_number() over (partition by id order by row_id desc) = 1""",
    "import_conflicts": f"""{_IM}, q as (select concat_ws(':', 'conflict', table_name[10:], provider, provider_record_id) id, table_name[10:] record_type, internal_id, provider, provider_record_id, reason conflicting_field, row_id from res where outcome = 'rejected_conflict')
        select * from q qualify row_number() over (partition by id order by row_id desc) = 1""",
    "import_report": f"""{_IM}, sv as (select pv provider, (issues)::bigint n from v join m using (match_row_id) where severity in ('fatal', 'error') union all select provenance.provider, 1 from vo join o using (odds_row_id) where severity in ('fatal', 'error')),
        pr as (select provider, {_REP} from res group by 1 union all select null, {_REP} from res), ss as (select provider, sum(n)::bigint severe from sv group by 1 union all select null, sum(n)::bigint from sv)
        select pr.*, coalesce(severe, 0)::bigint severe, 1 - coalesce(severe, 0) / "read"::double structural_validity_rate, 1 - coalesce(severe, 0) / "read"::double semantic_validity_rate, quarantined / "read"::double ambiguity_rate,
          skipped / "read"::double exact_duplicate_rate, rejected / "read"::double conflict_rate, accepted / "read"::double accepted_record_rate from pr left join ss on ss.provider is not distinct from pr.provider""",
    "historical_matches": f"""{_IM} select iid id, pv provider, competition_id, a_id player_a_id, b_id player_b_id, su scheduled_us, st start_us, du done_us, status, best_of, win winner_id,
        len(list_filter(sc, lambda s: s.set_number is not null))::bigint sets, epoch_us(provenance.ingested_at) ingested_us from mr where outcome = 'inserted'""",
    "dedupe_stored_matches": f"""{_M}, d0 as (select pv || ':' || rid id, match_row_id, provenance.ingested_at t, coalesce(provenance.ingested_at < '{STORED_BEFORE}'::timestamptz, false) old, {{'w': winner_external_id, 's': su, 'st': status, 'x': list_sort(coalesce(sets, []))}} c from m where rid is not null),
        sd as (select id, arg_min(c, (t, match_row_id)) c from d0 where old group by id),
        d as (select *, row_number() over (partition by id order by t, match_row_id) rn from d0 where not old),
        f1 as (select d.id, coalesce(sd.c, d.c) c, sd.id is not null has from d left join sd using (id) where rn = 1), f2 as (select id, min(rn) rn2, arg_min(c, rn) c2 from d where c.st <> 'scheduled' group by id),
        e as (select d.*, case when d.rn = 1 and not has then null when f1.c.st = 'scheduled' and f2.rn2 < d.rn then f2.c2 else f1.c end b, has from d join f1 using (id) left join f2 using (id))
        select match_row_id, case when rn = 1 and not has then 'inserted' when b is not distinct from c then 'skipped_idempotent' when b.st = 'scheduled' and c.st <> 'scheduled' then 'merged_safe' else 'rejected_conflict' end outcome,
          case when not (rn = 1 and not has) and b is distinct from c and not coalesce(b.st = 'scheduled' and c.st <> 'scheduled', false) then case when b.w is distinct from c.w then 'winner' when b.s is distinct from c.s then 'scheduled_at' else 'set scores' end end reason from e""",
    "adapt_matches": f"""select {_SRC}, {_J('competition_id')} competition_id, {_J('player_a_id')} player_a_external_id, {_J('player_b_id')} player_b_external_id, {_J('status')} status_raw, {_WORDS} status,
        try_cast({_J('best_of')} as int) best_of, {_J('winner_id')} winner_external_id, {_TS('scheduled_at')} scheduled_us, {_TS('completed_at')} completed_us, coalesce(json_array_length(payload, '$.sets'), 0)::bigint set_count,
        coalesce(list_sum(list_transform((payload->'$.sets')::json[], lambda s: (s->>'a')::bigint)), 0)::bigint points_a, coalesce(list_sum(list_transform((payload->'$.sets')::json[], lambda s: (s->>'b')::bigint)), 0)::bigint points_b,
        ({_J('status')} is not null and ({_WORDS}) is null)::bigint warnings from raw_record where record_type = 'match'""",
    "adapt_odds": f"""select {_SRC}, {_J('match_id')} provider_match_id, {_J('bookmaker')} bookmaker, {_J('selection_id')} selection_external_id, try_cast({_J('decimal_odds')} as double) decimal_odds, {_J('market_id')} market_id, {_TS('captured_at')} captured_us
        from raw_record where record_type = 'odds'""",
    "adapt_players": f"select {_SRC}, {_J('name')} \"name\", {_J('country')} country, try_cast({_J('ranking_hint')} as int) ranking_hint, provider_record_id external_player_id from raw_record where record_type = 'player'",
    "adapt_rankings": f"select {_SRC}, {_J('player_id')} player_external_id, try_cast({_J('ranking')} as int) ranking, try_cast({_J('ranking_points')} as double) ranking_points, {_TS('effective_at')} effective_us from raw_record where record_type = 'ranking'",
    "adapt_competitions": f"select {_SRC}, {_J('name')} \"name\", {_J('country')} country, {_J('level')} \"level\", {_J('season')} season, try_cast({_J('indoor')} as boolean) indoor from raw_record where record_type = 'competition'",
    "validate_matches": f"{_V} select match_row_id, severity, code, field_path, stage, issues from v",
    "severity_histogram": f"{_V} select severity, sum(issues)::bigint issues from v group by 1",
    "validation_outcomes": f"""{_V}, o as (select m.match_row_id, any_value(m.pv) provider, case when bool_or(severity in ('fatal', 'error')) then 'reject' else 'accept' end outcome, case {_REASON} else 'missing_critical_field' end r
        from m left join v on v.match_row_id = m.match_row_id group by 1) select provider, outcome, case when outcome = 'reject' then r end reason, count(*)::bigint match_rows from o group by all""",
    "validate_odds": f"{_M}, f as (select pv, rid, arg_min({{'e': coalesce(du, st, su)}}, match_row_id).e e from m where rid is not null group by all), {_OV.format(e='f.e', join='left join f on f.pv = i.provenance.provider and f.rid = i.provider_match_id')} select * from vo",
    "dedupe_matches": f"{_DD} select match_row_id, outcome, case when outcome = 'rejected_conflict' then r end reason from g",
    "import_metrics": f"""{_DD}, c as (select pv provider, count(*) n, count(*) filter (outcome = 'inserted') i, count(*) filter (outcome = 'merged_safe') mg, count(*) filter (outcome = 'skipped_idempotent') sk, count(*) filter (outcome = 'rejected_conflict') cf
        from g join m using (match_row_id) group by 1) select provider, n records, i inserted, mg merged, sk skipped, cf conflicts, i + mg + sk accepted, sk / n::double duplicate_rate, cf / n::double conflict_rate from c""",
    "dedupe_odds": f"""{_T}, d as (select odds_row_id, decimal_odds, first_value(decimal_odds) over w f, row_number() over w rn from imported_odds left join tm on tn = 'imported_odds' and ri = odds_row_id
        window w as (partition by provenance.provider, coalesce(provider_match_id, ''), coalesce(lower(trim(bookmaker)), ''), coalesce(selection_external_id, ''), coalesce(i::varchar, captured_at, '') order by provenance.ingested_at, odds_row_id))
        select odds_row_id, case when rn = 1 then 'inserted' when f is not distinct from decimal_odds then 'skipped_idempotent' else 'rejected_conflict' end outcome from d""",
    "cross_provider_duplicates": """with o as (select o_orderkey id, o_orderkey % 2 p, o_custkey % 10 a, o_orderkey % 7 + 10 b, epoch_us(o_orderdate) t from orders)
        select x.id, arg_min(y.id, {'t': y.t, 'i': y.id}) duplicate_of from o x join o y on x.a = y.a and x.b = y.b and x.p <> y.p and abs(x.t - y.t) <= 86400000000 group by x.id""",
}
