"""Queries of form, momentum before a match, patterns and normalised live rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions.columns import DAY_US
from matchlake.operators import form, normalise
from matchlake.operators.perspective import perspectives
from matchlake.plans import derived, imports, training
from matchlake.session import table

AS_OF_US = 915_148_800_000_000


def _history(spark: SparkSession, sf: str) -> DataFrame:
    m = derived.matches(spark, sf)
    status = m.select(F.col("id").alias("match_id"), F.when((F.col("id") % 17 == 0) & F.col("winner").isNotNull(), "walkover").otherwise(F.col("status")).alias("status"))
    return perspectives(m).join(status, "match_id").withColumn("opponent_ranking", F.when(F.col("opponent") % 5 != 0, (F.col("opponent") % 250 + 1).cast("int")))


def _round(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c, kind in df.dtypes if kind == "double"})


def form_score(spark: SparkSession, sf: str) -> DataFrame:
    return _round(form.form(_history(spark, sf), AS_OF_US))


def momentum_pre_match(spark: SparkSession, sf: str) -> DataFrame:
    return _round(form.pre_match_momentum(_history(spark, sf), AS_OF_US))


def patterns_long(spark: SparkSession, sf: str) -> DataFrame:
    return _round(form.patterns(_history(spark, sf)))


def repeated_history(spark: SparkSession, sf: str) -> DataFrame:
    return form.repeated_history(_history(spark, sf))


def normalize_odds(spark: SparkSession, sf: str) -> DataFrame:
    """Good and rejected odds rows, with the bookmaker as it is kept."""
    rows = imports.instants(spark, sf, table(spark, sf, "imported_odds"), captured_us="captured_at").select("odds_row_id", "provider_match_id", "bookmaker", "decimal_odds", "captured_us")
    good, bad = normalise.odds(rows, F.col("captured_us"))
    keep = lambda df, reason: df.select("odds_row_id", F.col("bookmaker"), reason.alias("reason"))
    return keep(good, F.lit(None).cast("string")).unionByName(keep(bad, F.col("reason")))


def normalize_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = imports.instants(spark, sf, table(spark, sf, "imported_match"), scheduled_us="scheduled_at").select("match_row_id", F.col("provenance.provider_record_id").alias("provider_match_id"), F.col("player_a_external_id").alias("player_a"), F.col("player_b_external_id").alias("player_b"), "status_raw", "scheduled_us")
    good, bad = normalise.matches(rows, F.col("scheduled_us"))
    none = F.lit(None).cast("string")
    return good.select("match_row_id", "status", none.alias("reason")).unionByName(bad.select("match_row_id", none.alias("status"), "reason"))


def pressure_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """How each side did at the pressure points of each match."""
    return _round(form.pressure_points(training.point_states(spark, sf)))


def normalize_players(spark: SparkSession, sf: str) -> DataFrame:
    """Good and rejected registrations, with the fields as they are kept."""
    rows = table(spark, sf, "imported_player").select("player_row_id", F.col("external_player_id").alias("provider_player_id"), F.col("name").alias("full_name"), F.col("country").alias("country_code"), F.col("ranking_hint").alias("world_ranking"))
    good, bad = normalise.players(rows)
    kept = good.select("player_row_id", "id", "name", "country", "ranking", F.lit(None).cast("string").alias("reason"))
    none = lambda kind: F.lit(None).cast(kind)
    return kept.unionByName(bad.select("player_row_id", none("string").alias("id"), none("string").alias("name"), none("string").alias("country"), none("int").alias("ranking"), "reason"))


QUERIES = {f.__name__: f for f in (form_score, momentum_pre_match, patterns_long, repeated_history, normalize_odds, normalize_matches, normalize_players, pressure_patterns)}

_PERF = "case when pf + pg = 0 then won * 100.0 else greatest(0.0, least(100.0, won * 100.0 + (pf - pg)::double / (pf + pg) * 15.0)) end"
_H = f"""with {derived.SQL}, h as (select p.*, case when match_id % 17 = 0 and m.winner is not null then 'walkover' else m.status end st, case when opponent % 5 <> 0 then opponent % 250 + 1 end rk,
  pow(0.5, greatest(0, ({AS_OF_US} - t) / {DAY_US}.0) / 90) age, {_PERF} perf from p join m on m.id = p.match_id)"""
_STATUS = " ".join(f"when '{k}' then '{v}'" for k, v in normalise.STATUS_WORDS.items())
ORACLE = {
    "form_score": f"""{_H}, f as (select player, won, case when st = 'walkover' then won * 100.0 else perf end sc, age, age * case when rk is null then 1.0 else 1 + 0.5 * greatest(0, least(1, (200 - rk) / 200.0)) end * case st when 'walkover' then 0.3 when 'retired' then 0.5 else 1.0 end w from h)
        select player, round(coalesce(greatest(0, least(100, sum(sc * w) filter (won is not null) / sum(w) filter (won is not null))), 50)::double, 9) form, count(won)::bigint form_n, round(least(1.0, count(won) / 3.0)::double, 9) confidence, round((avg(age) filter (won is not null))::double, 9) recency from f group by 1""",
    "momentum_pre_match": f"""{_H}, k as (select *, row_number() over (partition by player order by t desc, match_id desc) k from h where won is not null), f as (select *, first_value(won) over (partition by player order by k desc) e from k where k <= 5),
        g as (select player, sum(perf * age) / sum(age) s, count(*) n, any_value(e) e, count(*) - coalesce(min(0), 0) c, coalesce(max(k) filter (won <> e), 0) b, max(k) mk from f group by 1)
        select player, round(greatest(0, least(100, s + greatest(-20, least(20, 5.0 * (2 * e - 1) * (mk - b)))))::double, 9) momentum, n::bigint momentum_n from g""",
    "patterns_long": f"""{_H}, l as (
          select player, 'slow_starter' pattern, avg(1 - first_won) v, count(first_won) n from h group by 1 union all select player, 'strong_first_set', avg(first_won), count(first_won) from h group by 1
          union all select player, 'frequent_comeback', avg(won), count(won) from h where first_won = 0 group by 1 union all select player, 'weak_after_winning_first_set', avg(1 - won), count(won) from h where first_won = 1 group by 1
          union all select player, 'high_deciding_set_performance', avg(last_won), count(last_won) from h where decider group by 1 union all select player, 'straight_sets_tendency', avg((sa = 0 and sf > 0)::int), count(*) from h where won = 1 group by 1
          union all select player, 'late_set_collapse', sum(close_losses) / nullif(sum(sa), 0)::double, sum(sa) from h group by 1
          union all select player, 'high_volatility', least(1, stddev_pop(perf) / 50), count(*) from h where won is not null group by 1 having count(*) >= 2)
        select player, pattern, round(v::double, 9) "value", n::bigint n, round(least(1.0, n / 3.0)::double, 9) confidence from l where v is not null and n > 0""",
    "pressure_patterns": f"""{training._P}, s as (select match_id, pressure_n n, unnest([{{'k': 1, 'w': pressure_1}}, {{'k': 2, 'w': pressure_n - pressure_1}}]) u from ps where pressure_n > 0)
        select match_id, u.k::int side, 'strong_pressure_point_performance' pattern, round(u.w / n::double, 9) "value", n, round(least(1.0, n / 3.0)::double, 9) confidence from s""",
    "normalize_players": """with q as (select *, case when trim(coalesce(external_player_id, '')) = '' then 'blank player id' when trim(coalesce(name, '')) = '' then 'blank name' end reason from imported_player)
        select player_row_id, case when reason is null then external_player_id end id, case when reason is null then "name" end "name", case when reason is null then country end country, case when reason is null then ranking_hint end ranking, reason from q""",
    "repeated_history": f"{_H} select player, opponent, t \"at\", (count(*) - 1)::bigint repeats from h group by 1, 2, 3 having count(*) > 1",
    "normalize_odds": f"""{imports._T}, q as (select imported_odds.*, i from imported_odds left join tm on tn = 'imported_odds' and ri = odds_row_id), qr as (select *, case when trim(coalesce(provider_match_id, '')) = '' then 'blank match id' when trim(coalesce(bookmaker, '')) = '' then 'blank bookmaker' when decimal_odds is null or isnan(decimal_odds) or decimal_odds <= 1 then 'odds not above 1'
        when i is null then 'unreadable time' end reason from q) select odds_row_id, case when reason is null then trim(bookmaker) else bookmaker end bookmaker, reason from qr""",
    "normalize_matches": f"""{imports._T}, q as (select imported_match.*, i from imported_match left join tm on tn = 'imported_match' and fn = 'scheduled_at' and ri = match_row_id), qr as (select match_row_id, case lower(trim(status_raw)) {_STATUS} end s, case when trim(coalesce(provenance.provider_record_id, '')) = '' then 'blank match id'
          when trim(coalesce(player_a_external_id, '')) = '' or trim(coalesce(player_b_external_id, '')) = '' then 'blank player' when trim(player_a_external_id) = trim(player_b_external_id) then 'same player'
          when case lower(trim(status_raw)) {_STATUS} end is null then 'unknown status' when i is null then 'unreadable time' end reason from q)
        select match_row_id, case when reason is null then s end status, reason from qr""",
}
