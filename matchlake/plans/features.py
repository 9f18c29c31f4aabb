"""Point-in-time feature queries over the derived matches, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions.columns import DAY_US, HOUR_US
from matchlake.operators import asof, matchup, quotes, rolling, snapshots
from matchlake.operators.perspective import perspectives
from matchlake.plans import derived
from matchlake.session import written


def _probes(m: DataFrame) -> DataFrame:
    """The completed matches as questions: what was known about either side at their scheduled time."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("player")) for s, c in (("a", "player_a"), ("b", "player_b"))])
    return m.where("winner is not null").select(F.col("id").alias("match"), F.col("scheduled_us").alias("at"), F.inline(sides)).select("player", "at", F.struct("match", "side").alias("probe"))


def _history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = written(derived.matches(spark, sf))
    return m, written(perspectives(m)), _probes(m)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("probe.match").alias("match_id"), F.col("probe.side").alias("side"), *[c for c in df.columns if c != "probe"])


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine digits, without negative zero: sums of doubles depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"})


def rolling_windows(spark: SparkSession, sf: str) -> DataFrame:
    _, history, probes = _history(spark, sf)
    return _flat(rolling.window_features(rolling.window_rows(history, probes))).drop("player")


def rolling_win_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = rolling_windows(spark, sf)
    return rows.where("window_size in (0, 5)").select("match_id", "side", "window_size", "matches_played", "win_rate")


def rest_and_workload(spark: SparkSession, sf: str) -> DataFrame:
    _, history, probes = _history(spark, sf)
    return _flat(rolling.rest_and_workload(history, probes))


def form_and_volatility(spark: SparkSession, sf: str) -> DataFrame:
    _, history, probes = _history(spark, sf)
    return _flat(_rounded(rolling.form_and_volatility(history, probes)))


def result_streak(spark: SparkSession, sf: str) -> DataFrame:
    _, history, probes = _history(spark, sf)
    return _flat(rolling.result_streak(history, probes))


def head_to_head(spark: SparkSession, sf: str) -> DataFrame:
    m, history, _ = _history(spark, sf)
    probes = m.where("winner is not null").select(F.col("id").alias("probe"), F.col("player_a").alias("player"), F.col("player_b").alias("opponent"), F.col("scheduled_us").alias("at"), "competition_id", "best_of")
    return matchup.head_to_head(history, probes).withColumnRenamed("probe", "match_id")


def ranking_latest_before(spark: SparkSession, sf: str) -> DataFrame:
    _, _, probes = _history(spark, sf)
    ranks = derived.rankings(spark, sf).withColumn("id", F.col("ranking"))
    return _flat(asof.latest(ranks, probes, ["player"], ["ranking"], "id")).drop("at")


def odds_at_or_before(spark: SparkSession, sf: str) -> DataFrame:
    m = derived.matches(spark, sf)
    rows = derived.quotes(spark, sf)
    probes = m.select(F.col("id").alias("match_id"), F.col("scheduled_us").alias("at"), F.col("id").alias("probe"))
    found = asof.latest(rows, probes, ["match_id"], ["quote_id", "bookmaker", "odds_a", "odds_b"], "quote_id", inclusive=True)
    return found.select(F.col("probe").alias("match_id"), "quote_id", "bookmaker", "odds_a", "odds_b")


def odds_until_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """All quotes of each match at or before its schedule."""
    cutoffs = derived.matches(spark, sf).select(F.col("id").alias("match_id"), F.col("scheduled_us").alias("cutoff_us"))
    return quotes.known_quotes(derived.quotes(spark, sf), cutoffs).select("match_id", "quote_id", "at", "bookmaker", "odds_a")


def quote_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Each match with what its quotes say."""
    rows = quotes.summary(derived.matches(spark, sf).select(F.col("id").alias("match_id")), derived.quotes(spark, sf))
    return rows.withColumns({c: F.round(c, 7) + F.lit(0.0) for c in ("disagreement", "movement")})


def matchup_differentials(spark: SparkSession, sf: str) -> DataFrame:
    _, history, probes = _history(spark, sf)
    base = rolling.window_features(rolling.window_rows(history, probes, windows=())).select("probe", "win_rate")
    rest = rolling.rest_and_workload(history, probes).select("probe", "rest_hours", "matches_7d")
    form = rolling.form_and_volatility(history, probes).select("probe", "volatility")
    ranks = asof.latest(derived.rankings(spark, sf).withColumn("id", F.col("ranking")), probes, ["player"], ["ranking"], "id").select("probe", "ranking")
    every = base.join(rest, "probe").join(form, "probe").join(ranks, "probe")
    side = lambda s: every.where(F.col("probe.side") == s).withColumn("probe", F.col("probe.match"))
    return _rounded(matchup.differentials(side("a"), side("b"))).withColumnRenamed("probe", "match_id")


def _snapshots(spark: SparkSession, sf: str, of_windows: tuple[str, ...] = ()) -> DataFrame:
    m = derived.matches(spark, sf).withColumn("completeness", F.when(F.size("sets") > 0, 100).otherwise(80))
    return snapshots.snapshots(m, derived.rankings(spark, sf).withColumn("id", F.col("ranking")), of_windows=of_windows)


def feature_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that was known of each completed match at its schedule, in one row."""
    c, shown = F.col, ("matches_played", "win_rate", "point_win_rate")
    side = lambda s: [
        *[F.element_at(c(f"player_{s}_features.windows"), k + 1)[x].alias(f"{s}_{x}_{n}") for k, n in enumerate((0, *rolling.WINDOWS)) for x in shown],
        *[c(f"player_{s}_features.{x}").alias(f"{s}_{x}") for x in ("observation_count", "recency_weighted_win_rate", "volatility", "rest_hours", "matches_24h", "matches_7d", "result_streak", "ranking")],
    ]
    pair = ("meetings", "win_rate_a", "days_since_last", "form_differential", "rest_differential_hours", "workload_differential", "volatility_differential", "ranking_differential")
    known = ("repository_fingerprint", "input_fingerprint", "data_quality_score", "newest_source_us")
    rows = _snapshots(spark, sf, shown).select("target_match_id", "as_of_us", "player_a_id", "player_b_id", *side("a"), *side("b"), *[c(f"matchup_features.{x}").alias(x) for x in pair], *[c(f"provenance.{x}").alias(x) for x in known], F.concat_ws(",", "provenance.warnings").alias("warnings"), F.concat_ws(",", "provenance.missing_feature_names").alias("missing"))
    return _rounded(rows)


def engine_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.engine_inputs(_snapshots(spark, sf)).withColumn("unconvertible", F.size("unconvertible").cast("bigint"))


QUERIES = {f.__name__: f for f in (rolling_win_rate, rolling_windows, rest_and_workload, form_and_volatility, result_streak, head_to_head, ranking_latest_before, odds_at_or_before, odds_until_cutoff, quote_summary, matchup_differentials, feature_snapshots, engine_inputs)}

_SIDES = "pr as (select probe match_id, u.side, u.pl player, cut from probe, unnest([{'side': 'a', 'pl': pa}, {'side': 'b', 'pl': pb}]) w(u))"
_WITH = f"with {derived.SQL}, {_SIDES}, h as (select pr.match_id, side, pr.cut, p.* exclude (match_id), p.match_id src, row_number() over (partition by pr.match_id, side order by p.t desc, p.match_id::varchar desc) rn from pr left join p on p.player = pr.player and p.t < pr.cut)"
_WINDOW = """
select match_id, side, {size} window_size, count(t)::bigint matches_played, coalesce(sum(won), 0)::bigint wins, (count(won) - coalesce(sum(won), 0))::bigint losses, sum(won) / nullif(count(won), 0)::double win_rate,
 coalesce(sum(sf), 0)::bigint sets_won, coalesce(sum(sa), 0)::bigint sets_lost, sum(sf) / nullif(sum(sf) + sum(sa), 0)::double set_win_rate,
 coalesce(sum(pf), 0)::bigint points_won, coalesce(sum(pg), 0)::bigint points_lost, sum(pf) / nullif(sum(pf) + sum(pg), 0)::double point_win_rate,
 sum(sf - sa) filter (n > 0) / nullif(count(*) filter (n > 0), 0)::double average_set_margin, sum(pf - pg) filter (n > 0) / nullif(count(*) filter (n > 0), 0)::double average_point_margin,
 (count(*) filter (won = 1 and sa = 0 and sf > 0)) / nullif(sum(won), 0)::double straight_sets_win_rate, coalesce(sum(won), 0)::bigint straight_sets_n,
 (count(*) filter (decider)) / nullif(count(t), 0)::double deciding_set_appearance_rate, sum(last_won) filter (decider) / nullif(count(*) filter (decider), 0)::double deciding_set_win_rate, (count(*) filter (decider))::bigint deciding_set_n,
 sum(first_won) / nullif(count(first_won), 0)::double first_set_win_rate, count(first_won)::bigint first_set_n,
 sum(won) filter (first_won = 0) / nullif(count(won) filter (first_won = 0), 0)::double comeback_win_rate, (count(won) filter (first_won = 0))::bigint comeback_n,
 sum(1 - won) filter (first_won = 1) / nullif(count(won) filter (first_won = 1), 0)::double loss_rate_after_winning_first_set, (count(won) filter (first_won = 1))::bigint loss_after_first_n,
 sum(dur) / 60e6 / nullif(count(dur), 0)::double average_match_duration_minutes, count(dur)::bigint average_match_duration_n, (count(*) filter (incomplete))::bigint incomplete_match_count
from h{where} group by all"""
# A window counts at most its newest rows; probes with an empty history keep their row.
_WINDOWS = " union all ".join(_WINDOW.format(size=n, where=f" where rn <= {n}" if n else "").strip() for n in (0, *rolling.WINDOWS))
_PERF = "case when pf + pg = 0 then won * 100.0 else greatest(0.0, least(100.0, won * 100.0 + (pf - pg)::double / (pf + pg) * 15.0)) end"
_FORM = f"""f as (select match_id, side, sum(won * pow(0.5, (cut - t) / {DAY_US}.0 / 90)) / sum(pow(0.5, (cut - t) / {DAY_US}.0 / 90)) filter (won is not null) recency_weighted_win_rate,
  case when count(won) >= 2 then least(1.0, stddev_pop({_PERF}) filter (won is not null) / 50) end volatility from h group by all)"""
_REST = f"""r as (select match_id, side, (any_value(cut) - max(t))::double / {HOUR_US} rest_hours, (count(*) filter (t >= cut - 24 * {HOUR_US}))::bigint matches_24h, (count(*) filter (t >= cut - 168 * {HOUR_US}))::bigint matches_7d from h group by all)"""
_RANK = """q as (select o_custkey % n player, date_trunc('quarter', o_orderdate) q, sum(round(o_totalprice * 100)::bigint) c from orders, np group by all),
rk as (select player, epoch_us((q + interval 3 month)::timestamp) t, rank() over (partition by q order by c desc, player)::int ranking from q),
k as (select pr.match_id, side, arg_max(ranking, rk.t) ranking from pr left join rk on rk.player = pr.player and rk.t < pr.cut group by all)"""
_QUOTES = f"""with {derived.SQL}, c as (select count(*) n from orders), q as (select event_id quote_id, event_id % c.n mid, event_type bookmaker, 1.01 + abs(value) / 100 odds_a, 1.01 + abs(500 - value) / 100 odds_b, event_id from events, c),
        q2 as (select q.*, m.sched + (event_id % 49 - 24) * {HOUR_US} t, m.sched from q join m on m.id = mid)"""
_LASTN = [(0, "t is not null"), *((n, f"rn <= {n}") for n in rolling.WINDOWS)]
_LAST = ", ".join(f"(count(t) filter ({w}))::bigint matches_played_{k}, sum(won) filter ({w}) / nullif(count(won) filter ({w}), 0)::double win_rate_{k}, sum(pf) filter ({w}) / nullif(sum(pf + pg) filter ({w}), 0)::double point_win_rate_{k}" for k, w in _LASTN)
_HELD = "coalesce(sum(case when n > 0 then 100 else 80 end) filter (t is not null), 0)::bigint comp, " + ", ".join(f"coalesce(sum(('0x' || md5(src::varchar)[{1 + 10 * k}:{10 + 10 * k}])::bigint) filter (t is not null), 0)::bigint d{k}" for k in (0, 1))
_STREAK = """s as (select match_id, side, rn, won, t, first_value(won) over w fw, sum((won is distinct from fw0)::int) over (partition by match_id, side order by rn) breaks
        from (select *, first_value(won) over (partition by match_id, side order by rn) fw0 from h) window w as (partition by match_id, side order by rn)),
sk as (select match_id, side, (coalesce(any_value(case when fw = 1 then 1 when fw = 0 then -1 else 0 end), 0) * count(*) filter (breaks = 0 and t is not null))::bigint result_streak from s group by all)"""
_SNAP = f"""{_WITH}, {_REST}, {_FORM}, {_RANK}, {_STREAK},
sw as (select match_id, side, count(t)::bigint observation_count, max(t) newest, {_LAST}, {_HELD} from h group by all),
sd as (select * from sw join r using (match_id, side) join f using (match_id, side) join k using (match_id, side) join sk using (match_id, side)),
g as (select pb.probe, pb.cut, p.*, p.match_id src from probe pb left join p on p.player = pb.pa and p.opponent = pb.pb and p.t < pb.cut),
hb as (select probe match_id, any_value(cut) cut, count(t)::bigint meetings, sum(won) / nullif(count(won), 0)::double win_rate_a, (any_value(cut) - max(t))::double / {DAY_US} ago, {_HELD} from g group by 1),
sn as (select hb.match_id, hb.cut, probe.pa, probe.pb, a, b, hb, substr(sha256(concat_ws('|', a.observation_count, a.d0, a.d1, b.observation_count, b.d0, b.d1, hb.meetings, hb.d0, hb.d1)), 1, 16) fp,
  greatest(0, least(100, coalesce((a.comp + b.comp - hb.comp)::double / nullif(a.observation_count + b.observation_count - hb.meetings, 0), 100) - 15 * (a.observation_count < 1)::int - 15 * (b.observation_count < 1)::int - 5 * (hb.meetings = 0)::int))::double quality
  from hb join probe on probe.probe = hb.match_id join sd a on a.match_id = hb.match_id and a.side = 'a' join sd b on b.match_id = hb.match_id and b.side = 'b')"""
_SIDE = lambda s: ", ".join(
    [f"{s}.matches_played_{k} {s}_matches_played_{k}, round({s}.win_rate_{k}, 9) + 0.0 {s}_win_rate_{k}, round({s}.point_win_rate_{k}, 9) + 0.0 {s}_point_win_rate_{k}" for k, _ in _LASTN]
    + [f"{s}.{x} {s}_{x}" for x in ("observation_count", "matches_24h", "matches_7d", "result_streak", "ranking")]
    + [f"round({s}.{x}, 9) + 0.0 {s}_{x}" for x in ("recency_weighted_win_rate", "volatility", "rest_hours")]
)
ORACLE = {
    "feature_snapshots": f"""{_SNAP} select match_id target_match_id, cut as_of_us, pa player_a_id, pb player_b_id, {_SIDE("a")}, {_SIDE("b")}, hb.meetings, round(hb.win_rate_a, 9) + 0.0 win_rate_a, round(hb.ago, 9) + 0.0 days_since_last,
        round(a.win_rate_0 - b.win_rate_0, 9) + 0.0 form_differential, round(a.rest_hours - b.rest_hours, 9) + 0.0 rest_differential_hours, a.matches_7d - b.matches_7d workload_differential, round(a.volatility - b.volatility, 9) + 0.0 volatility_differential,
        (b.ranking - a.ranking)::double + 0.0 ranking_differential, fp repository_fingerprint, substr(sha256(concat_ws('|', match_id, pa, pb, strftime(make_timestamp(cut), '%Y-%m-%dT%H:%M:%S') || '+00:00', '1.0.0', '1.0.0', fp)), 1, 16) input_fingerprint,
        round(quality, 9) + 0.0 data_quality_score, greatest(a.newest, b.newest) newest_source_us,
        concat_ws(',', case when a.observation_count < 1 then 'player_a: too few observations' end, case when b.observation_count < 1 then 'player_b: too few observations' end, case when hb.meetings = 0 then 'no meetings' end) warnings,
        concat_ws(',', case when a.win_rate_0 is null then 'player_a.win_rate' end, case when b.win_rate_0 is null then 'player_b.win_rate' end, case when a.recency_weighted_win_rate is null then 'player_a.recency_weighted_win_rate' end,
          case when b.recency_weighted_win_rate is null then 'player_b.recency_weighted_win_rate' end, case when hb.win_rate_a is null then 'matchup.player_a_win_rate' end) missing from sn""",
    "engine_inputs": f"""{_SNAP}, w as (select *, hb.meetings m, case when hb.meetings > 0 and hb.win_rate_a is not null then round_even(hb.meetings * hb.win_rate_a, 0)::bigint end wa from sn)
        select match_id target_match_id, coalesce(wa, 0)::bigint wins_a, case when wa is null then 0 else m - wa end::bigint wins_b, case when wa is not null then cut - round(hb.ago * {DAY_US})::bigint end last_played_us, 8::bigint unconvertible from w""",
    "rolling_windows": f"{_WITH} {_WINDOWS}",
    "rolling_win_rate": f"{_WITH} select match_id, side, window_size, matches_played, win_rate from ({_WINDOWS}) where window_size in (0, 5)",
    "rest_and_workload": f"{_WITH}, {_REST} select r.match_id, r.side, pr.player, rest_hours, matches_24h, matches_7d from r join pr using (match_id, side)",
    "form_and_volatility": f"{_WITH}, {_FORM} select f.match_id, f.side, pr.player, round(recency_weighted_win_rate, 9) + 0.0 recency_weighted_win_rate, round(volatility, 9) + 0.0 volatility from f join pr using (match_id, side)",
    "result_streak": f"{_WITH}, {_STREAK} select sk.match_id, sk.side, pr.player, result_streak from sk join pr using (match_id, side)",
    "head_to_head": f"""with {derived.SQL}, g as (select pb.probe, pb.cut, pb.competition_id pc, pb.best_of pf2, p.*, row_number() over (partition by pb.probe order by t desc, match_id::varchar desc) rn
          from probe pb left join p on p.player = pb.pa and p.opponent = pb.pb and p.t < pb.cut)
        select probe match_id, count(t)::bigint meetings, sum(won) / nullif(count(won), 0)::double win_rate_a, 1 - sum(won) / nullif(count(won), 0)::double win_rate_b,
          sum(won) filter (rn <= 5) / nullif(count(won) filter (rn <= 5), 0)::double recent_win_rate_a, (count(won) filter (rn <= 5))::bigint recent_n,
          sum(sf - sa) filter (n > 0) / nullif(count(*) filter (n > 0), 0)::double average_set_margin_a, (count(*) filter (decider))::bigint deciding_set_meetings,
          sum(last_won) filter (decider) / nullif(count(*) filter (decider), 0)::double deciding_set_win_rate_a, (any_value(cut) - max(t))::double / {DAY_US} days_since_last,
          (count(*) filter (competition_id = pc))::bigint competition_meetings, sum(won) filter (competition_id = pc) / nullif(count(won) filter (competition_id = pc), 0)::double competition_win_rate_a,
          (count(*) filter (best_of = pf2))::bigint format_meetings, sum(won) filter (best_of = pf2) / nullif(count(won) filter (best_of = pf2), 0)::double format_win_rate_a
        from g group by probe""",
    "ranking_latest_before": f"{_WITH}, {_RANK} select match_id, side, ranking from k",
    "odds_at_or_before": f"""{_QUOTES}, b as (select mid, unnest(max({{'t': t, 'quote_id': quote_id, 'bookmaker': bookmaker, 'odds_a': odds_a, 'odds_b': odds_b}})) from q2 where t <= sched group by mid)
        select m.id match_id, quote_id, bookmaker, odds_a, odds_b from m left join b on b.mid = m.id""",
    "odds_until_cutoff": f"{_QUOTES} select mid match_id, quote_id, t \"at\", bookmaker, odds_a from q2 where t <= sched",
    "quote_summary": f"""{_QUOTES}, z as (select mid, count(*)::bigint quotes, min({{'t': -t, 'b': bookmaker, 'q': quote_id}}) p, arg_min(odds_a, {{'t': t, 'q': quote_id}}) fo, arg_max(odds_a, {{'t': t, 'q': quote_id}}) lo, stddev_pop(odds_a) sa, stddev_pop(odds_b) sb from q2 group by 1)
        select m.id match_id, coalesce(quotes, 0)::bigint quotes, p.q primary_id, p.b primary_bookmaker, fo first_odds, lo last_odds, round(case when quotes >= 2 then greatest(sa, sb) end, 7) + 0.0 disagreement, round(case when quotes >= 2 then abs(lo - fo) / fo end, 7) + 0.0 movement
        from m left join z on z.mid = m.id""",
    "matchup_differentials": f"""{_WITH}, {_REST}, {_FORM}, {_RANK}, w as (select match_id, side, sum(won) / nullif(count(won), 0)::double wr from h group by all),
        e as (select * from w join r using (match_id, side) join f using (match_id, side) join k using (match_id, side))
        select x.match_id, round(x.wr - y.wr, 9) + 0.0 form_differential, round(x.rest_hours - y.rest_hours, 9) + 0.0 rest_differential_hours, x.matches_7d - y.matches_7d workload_differential,
          round(x.volatility - y.volatility, 9) + 0.0 volatility_differential, (y.ranking - x.ranking)::double + 0.0 ranking_differential from e x join e y on x.match_id = y.match_id and x.side = 'a' and y.side = 'b'""",
}
