"""Windows over the events and file round trips, as queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.sources import export
from matchlake.streaming import imports
from matchlake.session import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = imports.event_windows(_events(spark, sf), "1 hour")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = imports.event_sessions(_events(spark, sf), "30 minutes")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events")


def export_flattened(spark: SparkSession, sf: str) -> DataFrame:
    """The stored feature snapshots with their nested columns flattened, as they are exported."""
    flat = export.flatten(table(spark, sf, "feature_snapshot"))
    flat = flat.withColumns({c: F.col(f"`{c}`").cast("timestamp_ntz") for c in ("as_of", "provenance.cutoff")})
    return flat.select(*[F.col(f"`{c}`").alias(c.replace(".", "__")) for c in flat.columns])


def snapshot_latest_before(spark: SparkSession, sf: str) -> DataFrame:
    """For each snapshot, the newest earlier snapshot of the same two players in either order."""
    from matchlake.operators import asof

    s = table(spark, sf, "feature_snapshot").select("snapshot_id", F.least("player_a_id", "player_b_id").alias("lo"), F.greatest("player_a_id", "player_b_id").alias("hi"), F.unix_micros("as_of").alias("at"))
    rows = s.withColumnRenamed("snapshot_id", "earlier_id")
    found = asof.latest(rows, s.withColumnRenamed("snapshot_id", "probe"), ["lo", "hi"], ["earlier_id"], "earlier_id")
    return found.select(F.col("probe").alias("snapshot_id"), "earlier_id")


QUERIES = {f.__name__: f for f in (event_windows, event_sessions, export_flattened, snapshot_latest_before)}
ORACLE = {
    "event_windows": "select date_trunc('hour', ts) \"start\", event_type, count(*)::bigint events, round(sum(value), 4) total from events group by all",
    "event_sessions": """with l as (select user_id, ts, (ts - lag(ts) over w >= interval 30 minute or lag(ts) over w is null)::int brk from events window w as (partition by user_id order by ts)),
        s as (select user_id, ts, sum(brk) over (partition by user_id order by ts) k from l) select user_id, min(ts) "start", count(*)::bigint events from s group by user_id, k""",
    "export_flattened": """select as_of::timestamp as_of, matchup_features.ranking_differential matchup_features__ranking_differential, player_a_features.observation_count player_a_features__observation_count,
        player_a_features.player_id player_a_features__player_id, player_a_features.ranking player_a_features__ranking, player_a_id, player_b_features.observation_count player_b_features__observation_count,
        player_b_features.player_id player_b_features__player_id, player_b_features.ranking player_b_features__ranking, player_b_id, provenance.builder_version provenance__builder_version, provenance.cutoff::timestamp provenance__cutoff,
        round(provenance.data_quality_score, 6) provenance__data_quality_score, provenance.input_fingerprint provenance__input_fingerprint, snapshot_id, target_match_id from feature_snapshot""",
    "snapshot_latest_before": """select s.snapshot_id, arg_max(e.snapshot_id, {'a': e.as_of, 'i': e.snapshot_id}) earlier_id from feature_snapshot s left join feature_snapshot e
        on least(e.player_a_id, e.player_b_id) = least(s.player_a_id, s.player_b_id) and greatest(e.player_a_id, e.player_b_id) = greatest(s.player_a_id, s.player_b_id) and e.as_of < s.as_of group by 1""",
}
