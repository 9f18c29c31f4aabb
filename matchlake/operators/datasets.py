"""Training examples, chronological splits and checks that nothing of the future leaks into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.columns import digests, short_hash
from matchlake.session import broadcast_if_small, written

#: Names of what is only known after a match.
FORBIDDEN = ("winner_id", "player_a_won", "result", "final_winner", "winner")


def with_cutoff(matches: DataFrame, policy: str = "scheduled") -> DataFrame:
    """Matches with cutoff_us and cutoff_warning. Policy "started" falls back to the schedule with a warning."""
    if policy not in ("scheduled", "started"):
        raise ValueError("policy is scheduled or started")
    if policy == "scheduled":
        return matches.withColumns({"cutoff_us": F.col("scheduled_us"), "cutoff_warning": F.lit(None).cast("string")})
    return matches.withColumns({"cutoff_us": F.coalesce("start_us", "scheduled_us"), "cutoff_warning": F.when(F.col("start_us").isNull(), "no start: the schedule is the cutoff")})


def examples(ids: DataFrame, matches: DataFrame, policy: str = "scheduled") -> tuple[DataFrame, DataFrame]:
    """(examples, skipped) of the match ids asked for. An example: match, sides, cutoff, label (1: the first side won).

    Ids without a match and matches without a result are skipped with a reason; repeated ids count once.
    """
    asked = ids.select(F.col("id").alias("__id")).distinct().join(matches, F.col("__id") == F.col("id"), "left")
    reason = F.when(F.col("id").isNull(), "not found").when(F.col("winner").isNull(), "not completed")
    marked = asked.withColumn("reason", reason)
    good = with_cutoff(marked.where("reason is null"), policy)
    label = (F.col("winner") == F.col("player_a")).cast("int").alias("label")
    return good.select(F.col("__id").alias("match_id"), "player_a", "player_b", "cutoff_us", "cutoff_warning", label), marked.where("reason is not null").select(F.col("__id").alias("match_id"), "reason")


def manifest(of: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: counts, label distribution, first and last cutoff, and a fingerprint of the example ids."""
    made = of.agg(F.count("*").alias("examples"), F.count_if(F.col("label") == 1).alias("a_wins"), F.count_if(F.col("label") == 0).alias("b_wins"), F.min("cutoff_us").alias("first_cutoff_us"), F.max("cutoff_us").alias("last_cutoff_us"), id_digest(F.col("match_id")).alias("fingerprint"))
    return made.crossJoin(F.broadcast(skipped.agg(F.count("*").alias("skipped"))))  # one row each


def id_digest(ids: Column) -> Column:
    """Fingerprint of a set of ids that needs no list of them: their number and the sums of two hashes, hashed."""
    sums = [F.coalesce(F.sum(d), F.lit(0)).cast("string") for d in digests(ids).values()]
    return short_hash(F.concat_ws("|", F.count(ids).cast("string"), *sums))


#: Rows that one part of an order holds.
PART_ROWS = 500_000


def positions(of: DataFrame, order: Sequence[str] = ("cutoff_us", "match_id"), part_rows: int = PART_ROWS) -> DataFrame:
    """``of`` with pos, its 0-based place in the order, and total; without sorting everything in one task.

    Rows are range-partitioned by the order into parts of about ``part_rows``, numbered inside their part, and moved on by
    what earlier parts hold. The parts are numbered in one task, a row each.
    """
    of = written(of)
    shards = max(8, -(-of.count() // part_rows))
    # Written once: the bounds of the parts come from a sample and must not be drawn twice.
    ranged = written(of.repartitionByRange(shards, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    base = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy()).alias("total"))
    return ranged.withColumn("__i", F.row_number().over(inside) - 1).join(broadcast_if_small(base), "__part").withColumn("pos", F.col("__base") + F.col("__i")).drop("__part", "__i", "__base")


def holdout(placed: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """``placed`` (pos, total) with split: train, validation or test, in order. No part is empty from 3 rows on."""
    n = F.col("total")
    train_end = F.greatest(F.lit(1), F.least(F.bround(n * train).cast("bigint"), n - 2))
    validation_end = F.greatest(train_end + 1, F.least(train_end + F.bround(n * validation).cast("bigint"), n - 1))
    return placed.where("total >= 3").withColumn("split", F.when(F.col("pos") < train_end, "train").when(F.col("pos") < validation_end, "validation").otherwise("test"))


def walk_forward(placed: DataFrame, folds: int = 5) -> DataFrame:
    """Rows with fold and split: fold i trains on the first i + 1 blocks of total // (folds + 1) and tests on the next."""
    if folds < 1:
        raise ValueError("folds must be positive")
    size = F.floor(F.col("total") / (folds + 1))
    each = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("__end", size * (F.col("fold") + 1))
    each = each.where((size > 0) & (F.col("pos") < F.col("__end") + size))
    return each.withColumn("split", F.when(F.col("pos") < F.col("__end"), "train").otherwise("test")).drop("__end")


def rolling_folds(placed: DataFrame, window: int, step: int) -> DataFrame:
    """Rows with fold and split: fold i trains on ``window`` rows from i * step on and tests on the next ``step``.

    The last fold's test may be shorter, never empty. A row is only multiplied by the folds that hold it.
    """
    if window < 1 or step < 1:
        raise ValueError("window and step must be positive")
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - window - step) / step) + 1)
    last = F.least(F.floor(F.col("pos") / step), F.floor((F.col("total") - window - 1) / step))
    each = placed.where(first <= last).withColumn("fold", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return each.withColumn("split", F.when(F.col("pos") < F.col("fold") * step + window, "train").otherwise("test"))


def leakage_report(
    of: DataFrame, sources: DataFrame, matches: DataFrame, splits: DataFrame | None = None, feature_names: Sequence[str] = (), odds: DataFrame | None = None, snapshots: DataFrame | None = None
) -> DataFrame:
    """(check, passed, violations) of a dataset; every check counts rows, none collects them.

    The checks run one after another when the report is made, so that the shuffle files of one are gone before the next.

    ``of``: match_id, cutoff_us; ``sources``: match_id, source_id (the matches whose data went into an example; the newest of
    each side stands for those before it); ``matches``: id, provider, provider_match_id, at (effective microseconds);
    ``splits``: match_id, split, pos; ``feature_names``: all columns that go into training, case aside; ``odds``: match_id,
    at of the quotes used; ``snapshots``: target_match_id, as_of_us of the features, one for each example.
    """
    cut = of.select("match_id", "cutoff_us")
    joined = sources.join(cut, "match_id").join(matches.select(F.col("id").alias("source_id"), "at"), "source_id")
    checks = [
        ("target_not_in_sources", sources.where("match_id = source_id")),
        ("sources_before_cutoff", joined.where("at >= cutoff_us")),
        ("no_duplicate_examples", of.groupBy("match_id").count().where("count > 1")),
        ("provider_mapping_consistent", matches.groupBy("provider", "provider_match_id").agg(F.countDistinct("id").alias("n")).where("n > 1")),
    ]
    if odds is not None:
        checks.append(("odds_at_or_before_cutoff", odds.join(cut, "match_id").where("at > cutoff_us")))
    if snapshots is not None:
        own = snapshots.select(F.col("target_match_id").alias("match_id"), "as_of_us")
        other = cut.join(own, "match_id", "full").where("cutoff_us is null or as_of_us is null or cutoff_us <> as_of_us")
        checks.append(("snapshot_matches_example", other))
    if splits is not None:
        order = splits.groupBy("split").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
        wide = order.select(F.max(F.when(F.col("split") == "train", F.col("hi"))).alias("t"), F.min(F.when(F.col("split") == "validation", F.col("lo"))).alias("v"), F.max(F.when(F.col("split") == "validation", F.col("hi"))).alias("w"), F.min(F.when(F.col("split") == "test", F.col("lo"))).alias("x"))
        checks += [
            ("no_example_in_two_splits", splits.groupBy("match_id").agg(F.countDistinct("split").alias("n")).where("n > 1")),
            ("splits_in_order", wide.where("t >= v or w >= x or t >= x")),
        ]
    spark = of.sparkSession
    bad = len({f.lower() for f in feature_names} & set(FORBIDDEN))
    out = spark.range(1).select(F.lit("no_forbidden_fields").alias("check"), F.lit(bad).cast("bigint").alias("violations"))
    for name, rows in checks:
        out = out.unionByName(written(rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")))
    return out.select("check", (F.col("violations") == 0).alias("passed"), "violations")


def fold_invariants(folds: DataFrame) -> DataFrame:
    """(fold, disjoint, in_order, progresses) of walk-forward or rolling folds: match_id, pos, fold, split.

    disjoint: no example is in both parts; in_order: all of train stands before all of test; progresses: its test begins
    after that of the fold before.
    """
    each = folds.groupBy("fold").agg(*[f(F.when(F.col("split") == s, F.col("pos"))).alias(n) for s, f, n in (("train", F.max, "train_hi"), ("test", F.min, "test_lo"))])
    twice = folds.groupBy("fold", "match_id").agg(F.countDistinct("split").alias("n")).groupBy("fold").agg(F.max("n").alias("most"))
    before = Window.partitionBy().orderBy("fold")  # a row a fold
    rows = each.join(twice, "fold").withColumn("was", F.lag("test_lo").over(before))
    return rows.select("fold", (F.col("most") == 1).alias("disjoint"), (F.col("train_hi") < F.col("test_lo")).alias("in_order"), (F.col("was").isNull() | (F.col("test_lo") > F.col("was"))).alias("progresses"))


def assert_no_leakage(report: DataFrame) -> None:
    """Raise if a check of the report failed."""
    if failed := [r.check for r in report.where("not passed").collect()]:  # one row a check
        raise ValueError(f"leakage: {', '.join(failed)}")
