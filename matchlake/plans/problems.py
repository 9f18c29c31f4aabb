"""Queries of the general data problems over the import tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.operators import deliveries, known_at, references, timestamps
from matchlake.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return deliveries.dropped_deliveries(table(spark, sf, "raw_record"))


def p1_kept_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Messages left per provider and type once every message is there exactly once."""
    kept = deliveries.deduplicated(table(spark, sf, "raw_record"))
    return kept.groupBy("provider", "record_type").agg(F.count("*").alias("messages"), F.min("fetched_at").cast("timestamp_ntz").alias("first_fetched"))


#: When the state of the references was last taken, in p5_current_keys.
STATE_AT = "2025-01-01 00:00:00+00:00"
#: The three fields of texts that denote instants: table, row id, field.
TIME_FIELDS = (("imported_match", "match_row_id", "scheduled_at"), ("imported_match", "match_row_id", "completed_at"), ("imported_odds", "odds_row_id", "captured_at"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in dict.fromkeys(t for t, _, _ in TIME_FIELDS):
        fields = [(r, f) for t, r, f in TIME_FIELDS if t == name]
        each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for _, f in fields])
        rows = table(spark, sf, name).select(F.lit(name).alias("table_name"), F.col(fields[0][0]).alias("row_id"), F.col("provenance.provider").alias("provider"), F.inline(each))
        out = rows if out is None else out.unionByName(rows)
    return out


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    zones = timestamps.source_zones(table(spark, sf, "provider_feed"))
    texts = _texts(spark, sf).where(F.col("text").isNotNull() & ~timestamps.is_normal_form(F.col("text")))
    rows = timestamps.with_instants(texts, "text", "provider", zones)
    return rows.where(F.col("instant_us").isNotNull()).select("table_name", "field_name", "row_id", "instant_us")


def p3_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    """How many non-null values of each field and provider denote no instant."""
    zones = timestamps.source_zones(table(spark, sf, "provider_feed"))
    rows = timestamps.with_instants(_texts(spark, sf), "text", "provider", zones)
    return rows.groupBy("table_name", "field_name", "provider").agg(F.count("text").alias("texts"), F.sum((F.col("text").isNotNull() & F.col("instant_us").isNull()).cast("bigint")).alias("unreadable"))


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    names = ("imported_match", "imported_odds", "imported_player", "historical_competition")
    return references.match_import_references({t: table(spark, sf, t) for t in names})


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_references(*_references(spark, sf)).select("table_name", "field_name", "row_id").distinct()


def p5_by_month(spark: SparkSession, sf: str) -> DataFrame:
    counts = references.orphans_by_period(references.orphan_references(*_references(spark, sf)))
    return counts.withColumn("period", F.col("period").cast("timestamp_ntz"))


def p5_current_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are referred to now and don't exist now, with their count of references; the counts are kept from one
    change of the tables to the next, here what came before STATE_AT and what came since."""
    made, targets = _references(spark, sf)
    changes = [references.deltas(made, "refs"), references.deltas(targets, "exists")]
    early = F.col("at") < F.lit(STATE_AT).cast("timestamp")
    state = references.apply_deltas(None, *[c.where(early) for c in changes])
    state = references.apply_deltas(state, *[c.where(~early) for c in changes])
    return references.orphan_keys(state).select("target", "provider", "key", "refs")


def _rankings_as_known(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots with the stored and the valid values."""
    snapshots = table(spark, sf, "feature_snapshot")
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("player")) for i, c in enumerate(("player_a_id", "player_b_id"))])
    asked = snapshots.select("snapshot_id", F.col("provenance.cutoff").alias("cutoff"), F.inline(sides)).withColumn("event", F.col("snapshot_id") * 2 + F.col("side"))
    known = known_at.known_at(
        asked, table(spark, sf, "historical_ranking"),
        event="event", entity="player", at="cutoff", version_entity="player_id", value="ranking", effective="effective_at", recorded="ingested_at", tie="id",
    )
    side = F.pmod(F.col("event"), F.lit(2))
    valid = known.groupBy(F.floor(F.col("event") / 2).cast("bigint").alias("snapshot_id")).agg(
        F.max(F.when(side == 0, F.col("value"))).alias("valid_a"), F.max(F.when(side == 1, F.col("value"))).alias("valid_b")
    )
    stored = snapshots.select("snapshot_id", F.col("player_a_features.ranking").cast("double").alias("stored_a"), F.col("player_b_features.ranking").cast("double").alias("stored_b"), F.col("matchup_features.ranking_differential").alias("stored_d"))
    return stored.join(valid, "snapshot_id").withColumn("valid_d", F.col("valid_b") - F.col("valid_a"))


def p6_values(spark: SparkSession, sf: str) -> DataFrame:
    return _rankings_as_known(spark, sf)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    fields = (("player_a_ranking", "a"), ("player_b_ranking", "b"), ("ranking_differential", "d"))
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"stored_{x}").eqNullSafe(F.col(f"valid_{x}")).alias("same")) for f, x in fields])
    return _rankings_as_known(spark, sf).select("snapshot_id", F.inline(each)).where(~F.col("same")).select("snapshot_id", "field_name").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_kept_by_type, p3_found, p3_unreadable, p5_found, p5_by_month, p5_current_keys, p6_found, p6_values)}

_P1 = """
with d as (select *, row_number() over (partition by provider, record_type, lower(trim(provider_record_id)) order by fetched_at, source_batch_id, delivery_id) n
           from raw_record)
"""
_P5 = """
with r as (
  select 'imported_match' table_name, f.field_name, match_row_id row_id, f.target, provenance.provider provider, f.key, provenance.ingested_at arrived, deleted_at withdrawn
  from imported_match, unnest([
    {'field_name': 'player_a_external_id', 'target': 'player', 'key': player_a_external_id},
    {'field_name': 'player_b_external_id', 'target': 'player', 'key': player_b_external_id},
    {'field_name': 'winner_external_id', 'target': 'player', 'key': winner_external_id},
    {'field_name': 'competition_id', 'target': 'competition', 'key': competition_id}]) u(f)
  union all
  select 'imported_odds', 'provider_match_id', odds_row_id, 'match', provenance.provider, provider_match_id, provenance.ingested_at, null from imported_odds
), r2 as (select * from r where trim(key) <> ''),
t as (
  select 'player' target, provenance.provider provider, external_player_id key, provenance.ingested_at arrived, deleted_at withdrawn from imported_player
  union all select 'match', provenance.provider, provenance.provider_record_id, provenance.ingested_at, deleted_at from imported_match
  union all select 'competition', provider, provider_competition_id, ingested_at, deleted_at from historical_competition
), o as (
  select * from r2 where not exists (select 1 from t where t.target = r2.target and t.provider = r2.provider and t.key = r2.key
     and t.arrived <= r2.arrived and (t.withdrawn is null or t.withdrawn > r2.arrived))
)
"""
_P6 = """
with s as (select snapshot_id, provenance.cutoff c, player_a_id a, player_b_id b, player_a_features.ranking::double stored_a, player_b_features.ranking::double stored_b,
                  matchup_features.ranking_differential stored_d from feature_snapshot),
k as (select s.snapshot_id, u.side, arg_max(h.ranking, {'e': h.effective_at, 'i': h.ingested_at}) v
      from s, unnest([{'side': 'a', 'p': s.a}, {'side': 'b', 'p': s.b}]) w(u) join historical_ranking h
        on h.player_id = u.p and h.effective_at < s.c and h.ingested_at < s.c group by all),
v as (select s.snapshot_id, stored_a, stored_b, stored_d, ka.v::double valid_a, kb.v::double valid_b, (kb.v - ka.v)::double valid_d from s
      left join k ka on ka.snapshot_id = s.snapshot_id and ka.side = 'a' left join k kb on kb.snapshot_id = s.snapshot_id and kb.side = 'b')
"""
# The zones' abbreviations in hours, and the local forms, by plain format patterns.
_HOURS = {"UTC": 0, "GMT": 0, "BST": 1, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "JST": 9, "AEST": 10, "AEDT": 11}
_P3 = f"""
with t as (
  select 'imported_match' table_name, 'scheduled_at' field_name, match_row_id row_id, provenance.provider provider, trim(scheduled_at) v from imported_match
  union all select 'imported_match', 'completed_at', match_row_id, provenance.provider, trim(completed_at) from imported_match
  union all select 'imported_odds', 'captured_at', odds_row_id, provenance.provider, trim(captured_at) from imported_odds
), z as (select t.*, time_zone, day_first, regexp_replace(v, '\\[.*\\]$', '') b, regexp_extract(v, ' ([A-Z]{{3,4}})$', 1) ab from t join provider_feed f on f.provider = t.provider where v is not null),
w as (select *, case
    when regexp_full_match(v, '\\d{{13}}') then v::bigint * 1000
    when regexp_full_match(v, '\\d{{10}}(\\.\\d+)?') then (v::decimal(20, 6) * 1000000)::bigint
    when regexp_full_match(b, '\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d(:?\\d\\d)?)') then epoch_us(try_cast(regexp_replace(b, '([+-]\\d\\d)(\\d\\d)$', '\\1:\\2') as timestamptz))
    when regexp_full_match(b, '\\d{{8}}T\\d{{6}}Z') then epoch_us(try_strptime(b, '%Y%m%dT%H%M%SZ'))
    when regexp_full_match(b, '.* (GMT)?[+-]\\d\\d:?\\d\\d') then epoch_us(coalesce(try_strptime(regexp_extract(b, '(\\d+ [A-Z][a-z]+ \\d{{4}} [0-9:]+)', 1), '%d %b %Y %H:%M:%S'), null))
      - (case when regexp_matches(b, '-\\d\\d:?\\d\\d$') then -1 else 1 end) * (regexp_extract(b, '[+-](\\d\\d):?(\\d\\d)$', 1)::bigint * 3600 + regexp_extract(b, '[+-](\\d\\d):?(\\d\\d)$', 2)::bigint * 60) * 1000000
    when ab in ({", ".join(repr(a) for a in _HOURS)}) then epoch_us(try_strptime(left(b, length(b) - length(ab) - 1), ['%d %b %Y %H:%M:%S', '%Y-%m-%d %H:%M:%S'])) - (case ab {" ".join(f"when '{a}' then {h}" for a, h in _HOURS.items())} end) * 3600000000
  end us,
  case when regexp_full_match(b, '\\d{{4}}-.*[0-9]') and not regexp_matches(b, '[+-]\\d\\d(:?\\d\\d)?$') or regexp_full_match(b, '\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d') then try_strptime(replace(replace(b, 'T', ' '), ',', '.'), ['%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M'])
    when regexp_full_match(b, '\\d\\d[/.].*') then case when day_first then try_strptime(replace(b, '.', '/'), ['%d/%m/%Y %H:%M', '%d/%m/%Y %I:%M %p']) else try_strptime(replace(b, '.', '/'), ['%m/%d/%Y %I:%M %p', '%m/%d/%Y %H:%M']) end
    when regexp_full_match(b, '[A-Z][a-z]+ \\d.*M') then try_strptime(b, '%b %d, %Y %I:%M %p') end loc from z),
l as (select *, timezone(time_zone, loc) u from w),
r as (select *, case when timezone(time_zone, u) = loc then case when timezone(time_zone, u - interval 1 hour) = loc then u - interval 1 hour else u end end first_pass from l)
"""
ORACLE = {
    "p3_found": _P3 + """select table_name, field_name, row_id, coalesce(us, epoch_us(first_pass)) instant_us from r
        where coalesce(us, epoch_us(first_pass)) is not null and not regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z')""",
    "p3_unreadable": _P3 + "select table_name, field_name, provider, count(*)::bigint texts, (count(*) filter (coalesce(us, epoch_us(first_pass)) is null))::bigint unreadable from r group by all",
    "p1_found": _P1 + "select delivery_id from d where n > 1",
    "p1_kept_by_type": _P1 + "select provider, record_type, count(*)::bigint messages, min(fetched_at)::timestamp first_fetched from d where n = 1 group by all",
    "p5_found": _P5 + "select distinct table_name, field_name, row_id from o",
    "p5_by_month": _P5 + "select table_name, field_name, date_trunc('month', arrived::timestamp)::timestamp period, count(*)::bigint orphans, count(distinct key)::bigint \"keys\" from o group by all",
    "p5_current_keys": _P5
    + """, n as (select target, provider, key, count(*)::bigint refs from r2 where withdrawn is null group by all)
        select * from n where not exists (select 1 from t where t.target = n.target and t.provider = n.provider and t.key = n.key and t.withdrawn is null)""",
    "p6_found": _P6
    + """select snapshot_id, u.f field_name from v, unnest([{'f': 'player_a_ranking', 's': stored_a, 'v': valid_a}, {'f': 'player_b_ranking', 's': stored_b, 'v': valid_b},
        {'f': 'ranking_differential', 's': stored_d, 'v': valid_d}]) w(u) where u.s is distinct from u.v""",
    "p6_values": _P6 + "select * from v",
}
