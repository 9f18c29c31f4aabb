"""References to records that do not exist.

Method: signed counts per key, kept from change deltas. A target row adds +1 to the existence of its key when it
arrives and -1 when it is withdrawn; a referring row adds to the key's count of references. A key with positive references
and zero existence is an orphan. Along time the same counts say when: at each instant at which a key is referred to,
its running existence is looked at, and if that is zero the references of that instant are orphans.

Scale: deltas are summed per key and instant before anything is ordered, and what is ordered is split into
blocks of time, so a key that holds a third of all rows is never one task's work. The references are only
semi-joined on (key, instant), which spreads such a key, and adaptive execution splits an instant that holds many.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("target", "provider", "key")
BLOCK_DAYS = 1


@dataclass(frozen=True)
class Reference:
    """A column of a table that refers to ``target``."""

    field: str
    target: str


def reference_rows(df: DataFrame, table_name: str, row_id: str, provider: Column, arrived: Column, references: Sequence[Reference], withdrawn: Column | None = None) -> DataFrame:
    """One row for each reference that ``df`` makes; null and blank values are none. Keys are taken as written."""
    each = F.array(*[F.struct(F.lit(r.field).alias("field_name"), F.lit(r.target).alias("target"), F.col(r.field).cast("string").alias("key")) for r in references])
    gone = withdrawn if withdrawn is not None else F.lit(None).cast("timestamp")
    rows = df.select(F.lit(table_name).alias("table_name"), F.col(row_id).cast("bigint").alias("row_id"), provider.alias("provider"), arrived.alias("arrived"), gone.alias("withdrawn"), F.explode(each).alias("r"))
    rows = rows.select("table_name", "r.field_name", "row_id", "r.target", "provider", "r.key", "arrived", "withdrawn")
    return rows.where(F.length(F.trim("key")) > 0)


def target_rows(df: DataFrame, target: str, provider: Column, key: Column, arrived: Column, withdrawn: Column | None = None) -> DataFrame:
    gone = withdrawn if withdrawn is not None else F.lit(None).cast("timestamp")
    rows = df.select(F.lit(target).alias("target"), provider.alias("provider"), key.cast("string").alias("key"), arrived.alias("arrived"), gone.alias("withdrawn"))
    return rows.where(F.col("provider").isNotNull() & F.col("key").isNotNull() & F.col("arrived").isNotNull())


def deltas(rows: DataFrame, count: str) -> DataFrame:
    """(key, at, signed change of ``count``). A row withdrawn before it arrived never was there."""
    change = F.array(
        F.struct(F.col("arrived").alias("at"), F.lit(1).alias("d")),
        F.struct(F.col("withdrawn").alias("at"), F.lit(-1).alias("d")),
    )
    lived = rows.where(F.col("withdrawn").isNull() | (F.col("withdrawn") > F.col("arrived")))
    each = lived.select(*KEY, F.explode(change).alias("c")).where(F.col("c.at").isNotNull())
    return each.groupBy(*KEY, F.col("c.at").alias("at")).agg(F.sum("c.d").alias(count)).where(F.col(count) != 0)


def apply_deltas(state: DataFrame | None, *changes: DataFrame) -> DataFrame:
    """The signed counts per key after ``changes``: frames with the key and ``refs`` and/or ``exists`` changes."""
    zero = F.lit(0).cast("bigint")
    frames = [] if state is None else [state]
    frames += [c.select(*KEY, *[(F.col(n).cast("bigint") if n in c.columns else zero).alias(n) for n in ("refs", "exists")]) for c in changes]
    total = frames[0]
    for f in frames[1:]:
        total = total.unionByName(f)
    return total.groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists")).where((F.col("refs") != 0) | (F.col("exists") != 0))


def orphan_keys(state: DataFrame) -> DataFrame:
    """The current report: keys with positive references and zero existence."""
    return state.where((F.col("refs") > 0) & (F.col("exists") == 0))


def existence_spans(changes: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(key, since, until) for each span in which the running existence count is positive; until null: still."""
    block = F.floor(F.unix_micros("at") / F.lit(block_days * 86_400_000_000))
    rows = changes.withColumn("__block", block)
    # Two levels: sums of whole blocks first, then the running count inside each block.
    sums = rows.groupBy(*KEY, "__block").agg(F.sum("exists").alias("__sum"), F.max("at").alias("__last"))
    earlier = Window.partitionBy(*KEY).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*KEY, "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*KEY, "__block").orderBy("at")
    rows = rows.join(starts, [*KEY, "__block"]).withColumn("__now", F.col("__before") + F.sum("exists").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__was", F.col("__now") - F.col("exists"))
    edges = rows.where((F.col("__now") > 0) != (F.col("__was") > 0)).select(*KEY, "at", (F.col("__now") > 0).alias("__up"))
    follow = Window.partitionBy(*KEY).orderBy("at")
    return edges.withColumn("until", F.lead("at").over(follow)).where("__up").select(*KEY, F.col("at").alias("since"), "until")


def split_settled(targets: DataFrame) -> DataFrame:
    """Targets with the rows that can't matter left out: of those never withdrawn, only a key's first arrival.

    Such a key exists from then on whatever else arrives, so one row holds all of them (summed on the map side).
    """
    stay = targets.where(F.col("withdrawn").isNull()).groupBy(*KEY).agg(F.min("arrived").alias("arrived")).withColumn("withdrawn", F.lit(None).cast("timestamp"))
    return stay.unionByName(targets.where(F.col("withdrawn").isNotNull()).select(*stay.columns))


def orphan_instants(references: DataFrame, targets: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(key, at, refs): the instants at which a key is referred to though its running existence is zero, and how often.

    ``references`` and ``targets`` with key, arrived, withdrawn; without nulls in key and arrived.
    """
    zero = F.lit(0).cast("bigint")
    made = references.groupBy(*KEY, F.col("arrived").alias("at")).agg(F.count("*").alias("refs")).withColumn("exists", zero)
    there = deltas(split_settled(targets), "exists").select(*KEY, "at", zero.alias("refs"), F.col("exists").cast("bigint").alias("exists"))
    both = made.unionByName(there).withColumn("__block", F.floor(F.unix_micros("at") / F.lit(block_days * 86_400_000_000)))
    # Two levels: sums of whole blocks first, then the running count inside each block; changes at one instant count as one.
    sums = both.groupBy(*KEY, "__block").agg(F.sum("exists").alias("__sum"))
    earlier = Window.partitionBy(*KEY).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*KEY, "__block", F.coalesce(F.sum("__sum").over(earlier), zero).alias("__before"))
    inside = Window.partitionBy(*KEY, "__block").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    now = both.join(starts, [*KEY, "__block"]).withColumn("__now", F.col("__before") + F.sum("exists").over(inside))
    return now.where((F.col("refs") > 0) & (F.col("__now") == 0)).select(*KEY, "at", "refs")


def orphan_references(references: DataFrame, targets: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """The references to keys that did not exist when the referring row arrived.

    A target exists from its arrival on (inclusive) until its withdrawal (exclusive). A null provider matches no
    target; a reference with unknown arrival is an orphan, since nothing is known to exist at its time.
    """
    complete = F.col("provider").isNotNull() & F.col("key").isNotNull() & F.col("arrived").isNotNull()
    known = references.where(complete)
    orphans = orphan_instants(known, targets, block_days).select(*KEY, F.col("at").alias("arrived"))
    return known.join(orphans, [*KEY, "arrived"], "left_semi").select(*references.columns).unionByName(references.where(~complete))


def orphans_by_period(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Orphans counted per table, field and period of arrival; an unknown arrival has a null period."""
    return orphans.groupBy("table_name", "field_name", F.date_trunc(period, "arrived").alias("period")).agg(F.count("*").alias("orphans"), F.countDistinct("key").alias("keys"))


def match_import_references(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(references, targets) of the match import tables."""
    m, o, p, c = (tables[t] for t in ("imported_match", "imported_odds", "imported_player", "historical_competition"))
    source, arrived = F.col("provenance.provider"), F.col("provenance.ingested_at")
    players = [Reference(f, "player") for f in ("player_a_external_id", "player_b_external_id", "winner_external_id")]
    references = reference_rows(m, "imported_match", "match_row_id", source, arrived, [*players, Reference("competition_id", "competition")], F.col("deleted_at")).unionByName(
        reference_rows(o, "imported_odds", "odds_row_id", source, arrived, [Reference("provider_match_id", "match")])
    )
    targets = (
        target_rows(p, "player", source, F.col("external_player_id"), arrived, F.col("deleted_at"))
        .unionByName(target_rows(m, "match", source, F.col("provenance.provider_record_id"), arrived, F.col("deleted_at")))
        .unionByName(target_rows(c, "competition", F.col("provider"), F.col("provider_competition_id"), F.col("ingested_at"), F.col("deleted_at")))
    )
    return references, targets
