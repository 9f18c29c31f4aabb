"""Queries of datasets, identity resolution, point sequences and snapshots, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.operators import asof, datasets, identity, sequences, snapshots
from matchlake.operators.perspective import perspectives
from matchlake.plans import derived, features
from matchlake.session import table, written
from matchlake.sources import export

FOLDS, ROLL, STEP = 5, 4000, 2500


def _examples(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = derived.matches(spark, sf)
    asked = m.select("id").unionByName(spark.range(1, 4).select((-F.col("id")).alias("id")))  # three ids that don't exist
    return datasets.examples(asked, m)


def training_examples(spark: SparkSession, sf: str) -> DataFrame:
    return _examples(spark, sf)[0].drop("cutoff_warning")


def training_skipped(spark: SparkSession, sf: str) -> DataFrame:
    return _examples(spark, sf)[1]


def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.manifest(*_examples(spark, sf))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.positions(_examples(spark, sf)[0].select("match_id", "cutoff_us", "label"))


def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.holdout(_placed(spark, sf)).select("match_id", "pos", "split")


def walk_forward_folds(spark: SparkSession, sf: str) -> DataFrame:
    rows = datasets.walk_forward(_placed(spark, sf), FOLDS)
    return rows.groupBy("fold", "split").agg(F.count("*").alias("examples"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("label").alias("a_wins"))


def rolling_window_folds(spark: SparkSession, sf: str) -> DataFrame:
    rows = datasets.rolling_folds(_placed(spark, sf), ROLL, STEP)
    return rows.groupBy("fold", "split").agg(F.count("*").alias("examples"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("label").alias("a_wins"))


def training_features(spark: SparkSession, sf: str) -> DataFrame:
    """The examples with their snapshots, flattened as they are exported; lists of windows as their number."""
    rows = snapshots.training_rows(_examples(spark, sf)[0], features._snapshots(spark, sf))
    flat = export.flatten(rows)
    size = {c for c, kind in flat.dtypes if kind.startswith("array")}
    return flat.select(*[(F.size(f"`{c}`").cast("bigint") if c in size else F.col(f"`{c}`")).alias(c.replace(".", "__")) for c in flat.columns])


def fold_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The invariants of the walk-forward and the rolling folds."""
    placed = written(_placed(spark, sf))
    out = [datasets.fold_invariants(rows).withColumn("scheme", F.lit(name)) for name, rows in (("walk_forward", datasets.walk_forward(placed, FOLDS)), ("rolling", datasets.rolling_folds(placed, ROLL, STEP)))]
    return out[0].unionByName(out[1])


def leakage_report(spark: SparkSession, sf: str) -> DataFrame:
    """All checks of the dataset of training_features: the newest source of either side, and each target whose own effective
    time is before its cutoff, as such a match would be part of its players' histories."""
    m = written(derived.matches(spark, sf))
    of = written(_examples(spark, sf)[0])
    history = perspectives(m).withColumn("source_id", F.col("match_id"))
    known = m.select("id", F.lit("derived").alias("provider"), F.col("id").alias("provider_match_id"), F.coalesce("done_us", "start_us", "scheduled_us").alias("at"))
    probes = of.select(F.explode(F.array("player_a", "player_b")).alias("player"), F.col("cutoff_us").alias("at"), F.col("match_id").alias("probe"))
    newest = asof.latest(history, probes, ["player"], ["source_id"], "source_id").where("source_id is not null").select(F.col("probe").alias("match_id"), "source_id")
    early = of.join(known.select(F.col("id").alias("match_id"), "at"), "match_id").where("at < cutoff_us").select("match_id", F.col("match_id").alias("source_id"))
    quoted = asof.latest(derived.quotes(spark, sf).withColumn("quoted_us", F.col("at")), of.select("match_id", F.col("cutoff_us").alias("at"), F.col("match_id").alias("probe")), ["match_id"], ["quoted_us"], "quote_id", inclusive=True)
    odds = quoted.where("quoted_us is not null").select(F.col("probe").alias("match_id"), F.col("quoted_us").alias("at"))
    made = features._snapshots(spark, sf)
    names = [c for part in ("player_a_features", "player_b_features", "matchup_features") for c in made.schema[part].dataType.fieldNames()]
    placed = datasets.holdout(datasets.positions(of.select("match_id", "cutoff_us")))
    return datasets.leakage_report(of, written(newest.unionByName(early)), known, placed, names, odds, made.select("target_match_id", "as_of_us"))


def snapshot_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality, warnings and missing features of each completed match's snapshot."""
    p = F.col("provenance")
    return features._snapshots(spark, sf).select(F.col("target_match_id").alias("match_id"), F.round(p["data_quality_score"], 9).alias("quality"), F.concat_ws(",", p["warnings"]).alias("warnings"), F.concat_ws(",", p["missing_feature_names"]).alias("missing"))


def snapshot_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """What binds each snapshot's sources and inputs."""
    p = F.col("provenance")
    return features._snapshots(spark, sf).select(F.col("target_match_id").alias("match_id"), p["repository_fingerprint"].alias("repository_fingerprint"), p["input_fingerprint"].alias("input_fingerprint"))


def identity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    candidates = table(spark, sf, "player_candidate")
    return identity.resolve(candidates, table(spark, sf, "player_identity")).select("candidate_id", "outcome", "identity_id", "score", "margin")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each user as the points of one match, in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", (1 + F.col("event_id") % 2).cast("int").alias("winner")).withColumn("seq", F.row_number().over(order))
    e = e.withColumn("set_number", (1 + F.floor((F.col("seq") - 1) / 20)).cast("int"))
    inside = Window.partitionBy("user_id", "set_number").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    score = lambda p: F.sum((F.col("winner") == p).cast("int")).over(inside)
    return e.select(F.col("user_id").alias("match_id"), "seq", "set_number", "winner", score(1).alias("score_1"), score(2).alias("score_2"))


def point_states(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.point_states(_points(spark, sf))


def set_states(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.set_states(_points(spark, sf))


def momentum_in_play(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.momentum(_points(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        training_examples, training_skipped, dataset_manifest, holdout_split, walk_forward_folds, rolling_window_folds, leakage_report, training_features, fold_checks,
        snapshot_quality, snapshot_fingerprint, identity_resolution, point_states, set_states, momentum_in_play,
    )
}

_E = f"""with {derived.SQL}, asked as (select id from m union all select -range id from range(1, 4)),
ex as (select m.id match_id, m.pa player_a, m.pb player_b, m.sched cutoff_us, (m.winner = m.pa)::int "label" from asked join m using (id) where m.winner is not null),
sk as (select asked.id match_id, case when m.id is null then 'not found' else 'not completed' end reason from asked left join m on m.id = asked.id where m.winner is null),
pl as (select *, row_number() over (order by cutoff_us, match_id) - 1 pos, count(*) over () n from ex)"""
_H = "case when pos < greatest(1, least(round_even(n * 0.6, 0)::bigint, n - 2)) then 'train' when pos < greatest(greatest(1, least(round_even(n * 0.6, 0)::bigint, n - 2)) + 1, least(greatest(1, least(round_even(n * 0.6, 0)::bigint, n - 2)) + round_even(n * 0.2, 0)::bigint, n - 1)) then 'validation' else 'test' end"
_FOLD = 'select fold, split, count(*)::bigint examples, min(pos)::bigint first_pos, max(pos)::bigint last_pos, sum("label")::bigint a_wins from f group by all'
_P = """with p0 as (select user_id match_id, 1 + event_id % 2 winner, row_number() over (partition by user_id order by ts, event_id) seq from events),
p1 as (select *, (1 + (seq - 1) // 20)::int set_number from p0),
pt as (select *, sum((winner = 1)::int) over w s1, sum((winner = 2)::int) over w s2, max(seq) over (partition by match_id) last from p1 window w as (partition by match_id, set_number order by seq)),
ld as (select *, last_value(case when s1 > s2 then 1 when s2 > s1 then 2 end ignore nulls) over (partition by match_id order by seq) lead_ from pt),
l2 as (select *, lag(lead_) over (partition by match_id order by seq) was, first_value(winner) over (partition by match_id order by seq desc) fin from ld),
br as (select match_id, max(seq) filter (winner <> fin) b from l2 group by 1),
ps as (select l2.match_id, count(*)::bigint points, (case when any_value(fin) = 1 then 1 else -1 end * (count(*) - coalesce(any_value(b), 0)))::bigint trailing_points, (count(*) filter (lead_ <> was))::bigint lead_changes,
  (count(*) filter (s1 >= 9 and s2 >= 9))::bigint pressure_n, (count(*) filter (s1 >= 9 and s2 >= 9 and winner = 1))::bigint pressure_1,
  coalesce(sum(case when winner = 1 then 1 else -1 end) filter (seq > last - 10), 0)::bigint recent_net from l2 join br using (match_id) group by 1),
sw0 as (select match_id, set_number, arg_max(s1, seq) a, arg_max(s2, seq) b from pt group by all),
sw as (select match_id, set_number, case when a > b then 1 else 2 end w, row_number() over (partition by match_id order by set_number) i from sw0 where a <> b),
sl as (select *, lead(w) over (partition by match_id order by i) nx, first_value(w) over (partition by match_id order by i desc) fin from sw),
ss as (select match_id, (case when any_value(fin) = 1 then 1 else -1 end * (count(*) - coalesce(max(i) filter (w <> fin), 0)))::bigint trailing_sets, (count(*) filter (w <> 1 and nx is not null))::bigint losses_1, (count(*) filter (w <> 1 and nx = 1))::bigint recoveries_1,
  (count(*) filter (w <> 2 and nx is not null))::bigint losses_2, (count(*) filter (w <> 2 and nx = 2))::bigint recoveries_2 from sl group by 1)"""
ORACLE = {
    "training_examples": f"{_E} select * from ex",
    "training_skipped": f"{_E} select * from sk",
    "dataset_manifest": f"""{_E} select count(*)::bigint examples, (count(*) filter ("label" = 1))::bigint a_wins, (count(*) filter ("label" = 0))::bigint b_wins, min(cutoff_us) first_cutoff_us, max(cutoff_us) last_cutoff_us, substr(sha256(concat_ws('|', count(match_id), coalesce(sum(('0x' || md5(match_id::varchar)[1:10])::bigint), 0), coalesce(sum(('0x' || md5(match_id::varchar)[11:20])::bigint), 0))), 1, 16) fingerprint, (select count(*) from sk)::bigint skipped from ex""",
    "holdout_split": f"{_E} select match_id, pos::bigint pos, {_H} split from pl where n >= 3",
    "walk_forward_folds": f"{_E}, f as (select pl.*, k.range::int fold, case when pos < (n // {FOLDS + 1}) * (k.range + 1) then 'train' else 'test' end split from pl, range({FOLDS}) k where pos < (n // {FOLDS + 1}) * (k.range + 2)) {_FOLD}",
    "rolling_window_folds": f"{_E}, f as (select pl.*, k.range::int fold, case when pos < k.range * {STEP} + {ROLL} then 'train' else 'test' end split from pl, range(1000) k where k.range * {STEP} + {ROLL} < n and pos >= k.range * {STEP} and pos < k.range * {STEP} + {ROLL + STEP}) {_FOLD}",
    "leakage_report": "select unnest(['target_not_in_sources', 'sources_before_cutoff', 'no_duplicate_examples', 'provider_mapping_consistent', 'no_example_in_two_splits', 'splits_in_order', 'no_forbidden_fields', 'odds_at_or_before_cutoff', 'snapshot_matches_example']) \"check\", true passed, 0::bigint violations",
    "snapshot_quality": f"select target_match_id match_id, data_quality_score quality, warnings, missing from ({features.ORACLE['feature_snapshots']})",
    "snapshot_fingerprint": f"select target_match_id match_id, repository_fingerprint, input_fingerprint from ({features.ORACLE['feature_snapshots']})",
    "fold_checks": f"""{_E}, f as (select 'walk_forward' scheme, k.range::int fold, case when pos < (n // {FOLDS + 1}) * (k.range + 1) then 'train' else 'test' end split, pos, match_id from pl, range({FOLDS}) k where pos < (n // {FOLDS + 1}) * (k.range + 2)
          union all select 'rolling', k.range::int, case when pos < k.range * {STEP} + {ROLL} then 'train' else 'test' end, pos, match_id from pl, range(1000) k where k.range * {STEP} + {ROLL} < n and pos >= k.range * {STEP} and pos < k.range * {STEP} + {ROLL + STEP}),
        g as (select scheme, fold, max(pos) filter (split = 'train') hi, min(pos) filter (split = 'test') lo, count(*) c, count(distinct match_id) d from f group by all)
        select scheme, fold, c = d disjoint, hi < lo in_order, coalesce(lo > lag(lo) over (partition by scheme order by fold), true) progresses from g""",
    "point_states": f"{_P} select * from ps",
    "set_states": f"{_P} select * from ss",
    "momentum_in_play": f"""{_P}, c as (select ps.*, ss.* exclude (match_id), case when coalesce(trailing_points, 0) = 0 then 50.0 else 50 + sign(trailing_points) * least(50, least(abs(trailing_points), 10) * 5) end a,
          case when coalesce(trailing_sets, 0) = 0 then 50.0 else 50 + sign(trailing_sets) * least(50, abs(trailing_sets) * 15) end b, case when coalesce(losses_1, 0) = 0 then 50.0 else 100.0 * recoveries_1 / losses_1 end r,
          case when pressure_n = 0 then 50.0 else 100.0 * pressure_1 / pressure_n end p, greatest(0, least(100, 50.0 + recent_net * 10)) d from ps left join ss using (match_id)),
        o as (select *, greatest(0.0, least(100.0, 0.25 * a + 0.2 * b + 0.15 * r + 0.2 * p + 0.2 * d))::double one from c)
        select match_id, one momentum_1, 100 - one momentum_2, least(1.0, points / 8.0)::double * (1 - least(0.5, lead_changes / 10.0))::double confidence from o""",
}
