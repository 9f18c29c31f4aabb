"""Classification of staged rows against stored ones and against each other.

Rows of one key are taken in order of arrival, and each is compared with what the key held before it (the stored row, else
the first staged one), so repeats inside a batch are seen too. What a key held comes from aggregates over its rows,
filled on the map side and joined back, so one key with a third of all rows is no single task's work. Keys are internal
ids; ties are broken by the row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_SECONDS = 300
CONTENT = ("winner", "scheduled_us", "status", "sets")


def _firsts(staged: DataFrame, **values: Column) -> DataFrame:
    """(__key, and for each value the first row's (arrived, row_id, v) among rows where it is not null)."""
    return staged.groupBy(F.col("id").alias("__key")).agg(*[F.min(F.when(v.isNotNull(), F.struct("arrived", "row_id", v.alias("v")))).alias(n) for n, v in values.items()])


def _before(name: str) -> Column:
    """The value of ``name`` if its row came before this one."""
    return F.when(F.struct(F.col(f"{name}.arrived"), F.col(f"{name}.row_id")) < F.struct("arrived", "row_id"), F.col(f"{name}.v"))


def match_outcomes(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """``staged`` with outcome and reason.

    Both: id, winner, scheduled_us, status, sets; staged also arrived and row_id; stored ids are unique. inserted:
    new; skipped_idempotent: same content; merged_safe: the earlier one was only scheduled; else rejected_conflict,
    which names the first field that differs. A rejected or skipped row does not replace what it is compared with.
    """
    body = F.struct(*[F.array_sort(F.coalesce(F.col(c), F.array().cast(staged.schema[c].dataType))).alias(c) if c == "sets" else F.col(c) for c in CONTENT])
    old = stored.select(F.col("id").alias("__id"), body.alias("__stored"))
    rows = staged.withColumn("__new", body)
    # What a row is compared with is fixed by the first row that sets it: the stored one, else the first staged
    # one, until the first staged row that is no longer scheduled.
    first = _firsts(rows, __first=F.col("__new"), __played=F.when(F.col("__new.status") != "scheduled", F.col("__new")))
    rows = rows.join(first, rows["id"] == F.col("__key"), "left").join(old, rows["id"] == F.col("__id"), "left").drop("__id", "__key")
    base = F.coalesce(F.col("__stored"), _before("__first"))
    later = _before("__played")
    before = F.when(base.isNull(), base).when((base["status"] == "scheduled") & later.isNotNull(), later).otherwise(base)
    rows = rows.withColumn("__before", before)
    b, n = F.col("__before"), F.col("__new")
    same = F.lit(True)
    for c in CONTENT:
        same = same & b[c].eqNullSafe(n[c])
    merged = (b["status"] == "scheduled") & (n["status"] != "scheduled")
    differs = F.when(~b["winner"].eqNullSafe(n["winner"]), "winner").when(~b["scheduled_us"].eqNullSafe(n["scheduled_us"]), "scheduled_at").otherwise("set scores")
    result = F.when(b.isNull(), "inserted").when(same, "skipped_idempotent").when(F.coalesce(merged, F.lit(False)), "merged_safe").otherwise("rejected_conflict")
    return rows.withColumn("outcome", result).withColumn("reason", F.when(F.col("outcome") == "rejected_conflict", differs)).drop("__stored", "__new", "__before", "__first", "__played")


def odds_outcomes(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """``staged`` with outcome: inserted, skipped_idempotent (same odds) or rejected_conflict.

    Both: id and decimal_odds; staged also arrived and row_id.
    """
    old = stored.groupBy(F.col("id").alias("__id")).agg(F.first("decimal_odds").alias("__odds"), F.lit(True).alias("__has"))
    first = _firsts(staged, __first=F.struct("decimal_odds"))
    rows = staged.join(first, staged["id"] == F.col("__key"), "left").join(old, staged["id"] == F.col("__id"), "left").drop("__id", "__key")
    earlier = _before("__first")
    has = F.coalesce(F.col("__has"), earlier.isNotNull())
    base = F.when(F.col("__has"), F.col("__odds")).otherwise(earlier["decimal_odds"])
    result = F.when(~has, "inserted").when(base.eqNullSafe(F.col("decimal_odds")), "skipped_idempotent").otherwise("rejected_conflict")
    return rows.withColumn("outcome", result).drop("__odds", "__has", "__first")


def cross_provider(matches: DataFrame, seconds: int = WINDOW_SECONDS, others: DataFrame | None = None) -> DataFrame:
    """(id, duplicate_of): matches of one unordered pair of players that another provider has near the same time.

    ``matches``: id, provider, player_a, player_b, scheduled_us. Near is at most ``seconds`` apart; the smallest
    (time, id) is named. ``others``: what they are compared with (themselves if not given), with arrived and row_id on both
    sides, nulls first: only what came earlier counts. An equi-join on pair and bucket of time with its neighbours, so that
    a pair of players that meets often is spread over buckets.
    """
    width = max(1, seconds) * 1_000_000
    order = [] if others is None else ["arrived", "row_id"]

    def keyed(df: DataFrame) -> DataFrame:
        known = df.where("scheduled_us is not null and player_a is not null and player_b is not null")
        return known.select("id", "provider", "scheduled_us", *order, F.least("player_a", "player_b").alias("lo"), F.greatest("player_a", "player_b").alias("hi"), F.floor(F.col("scheduled_us") / width).alias("bucket"))

    near = keyed(matches if others is None else others).select("lo", "hi", F.col("id").alias("other"), F.col("provider").alias("p2"), F.col("scheduled_us").alias("t2"), *[F.col(c).alias(f"{c}_2") for c in order], F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    hits = keyed(matches).join(near, ["lo", "hi", "bucket"]).where((F.col("p2") != F.col("provider")) & (F.abs(F.col("t2") - F.col("scheduled_us")) <= seconds * 1_000_000))
    if order:
        hits = hits.where(F.struct("arrived_2", "row_id_2") < F.struct("arrived", "row_id"))
    return hits.groupBy("id").agg(F.min(F.struct("t2", "other")).alias("m")).select("id", F.col("m.other").alias("duplicate_of"))
