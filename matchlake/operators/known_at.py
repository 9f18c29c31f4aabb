"""Attributes as known at event time.

Method: events and attribute versions are co-grouped by entity, and a vectorised binary search finds, for each
event, the latest version that was both valid and recorded before the event.

A version can be seen by an event once it is both effective and recorded, so it is ordered by the later of the
two times; a running maximum of (effective, recorded) along that order then names the answer at every point, and
one ``searchsorted`` answers all events of a batch.

Scale: a co-group is a shard of entities of about ROWS_PER_SHARD rows. An entity with more rows than that is cut along time
into cells of about so many rows, so no entity is one task's work as a whole. What came before a cell is carried in as a
single row: of the earlier versions, all visible throughout the cell, only the greatest can win. It comes from a maximum
that is aggregated per entity and cell on the map side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.session import broadcast_if_small, cut_lineage

#: Length of the slices of time in which the rows of a large entity are counted.
SPAN_DAYS = 1
ROWS_PER_SHARD = 100_000
_DAY_US = 86_400_000_000
#: More parts than a slice is ever cut into.
_PARTS = 2**24


def _search(events: pd.DataFrame, versions: pd.DataFrame) -> pd.DataFrame:
    """Both with entity; events: at, event; versions: seen, effective, recorded, tie, value. One row an event."""
    if not len(events):
        return pd.DataFrame({"__event": [], "__value": [], "__found": []})
    value, found = np.full(len(events), np.nan), np.zeros(len(events), dtype=bool)
    if len(versions):
        n = len(versions)
        codes, _ = pd.factorize(pd.concat([versions["__entity"], events["__entity"]], ignore_index=True))
        seen = versions["__seen"].to_numpy()
        # Rank of each version in (effective, recorded, tie); its running maximum in order of visibility.
        rank = np.empty(n, dtype=np.int64)
        by_value = np.lexsort((versions["__tie"].to_numpy(), versions["__recorded"].to_numpy(), versions["__effective"].to_numpy()))
        rank[by_value] = np.arange(n)
        order = np.lexsort((seen, codes[:n]))
        entity = codes[:n][order].astype(np.int64)
        best = np.maximum.accumulate(rank[order] + entity * n) - entity * n
        # (entity, time) as one number: times are replaced by their dense rank over both sides.
        at = events["__at"].to_numpy()
        times = np.unique(np.concatenate([seen, at]))
        width = len(times) + 1
        keys = entity * width + np.searchsorted(times, seen[order])
        wanted = codes[n:].astype(np.int64)
        k = np.searchsorted(keys, wanted * width + np.searchsorted(times, at), side="left") - 1  # strictly before
        found = (k >= 0) & (entity[np.maximum(k, 0)] == wanted)
        value[found] = versions["__value"].to_numpy(dtype=np.float64, na_value=np.nan)[by_value[best[k[found]]]]
    return pd.DataFrame({"__event": events["__event"].to_numpy(), "__value": value, "__found": found})


def _cells(rows: DataFrame, large: DataFrame, span_days: int, most: int) -> DataFrame:
    """(__entity, __span, __cell, __parts): slices of time of ``large`` entities gathered into cells of about ``most`` rows.

    ``rows``: __entity, __time. A slice with more rows than that is cut into __parts equal parts of time.
    """
    slices = rows.join(large, "__entity", "left_semi").groupBy("__entity", F.floor(F.col("__time") / F.lit(span_days * _DAY_US)).alias("__span")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__entity").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    return slices.select("__entity", "__span", F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / most).alias("__cell"), F.least(F.ceil(F.col("__n") / most), F.lit(_PARTS)).alias("__parts"))


def known_at(
    events: DataFrame,
    versions: DataFrame,
    *,
    event: str,
    entity: str,
    at: str,
    version_entity: str,
    value: str,
    effective: str,
    recorded: str,
    tie: str | None = None,
    span_days: int = SPAN_DAYS,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """(event, value, found): for each event the numeric value as known strictly before its time.

    Of an entity's versions with effective and recorded both before ``at``, the one with the latest effective,
    then recorded, then (arbitrary but fixed) hash of ``tie`` counts. Events with a null id, entity or time, and events
    before the entity's first visible version, get found = false and a null value; so does, with found = true,
    a version whose value is null. Versions without entity, effective or recorded time are never visible.
    """
    e = events.select(F.col(event).alias("__event"), F.col(entity).cast("string").alias("__entity"), F.unix_micros(F.col(at).cast("timestamp")).alias("__at"))
    v = versions.select(
        F.col(version_entity).cast("string").alias("__entity"),
        F.unix_micros(F.col(effective).cast("timestamp")).alias("__effective"),
        F.unix_micros(F.col(recorded).cast("timestamp")).alias("__recorded"),
        (F.xxhash64(tie) if tie else F.lit(0)).cast("bigint").alias("__tie"),
        F.col(value).cast("double").alias("__value"),
    ).where(F.col("__entity").isNotNull() & F.col("__effective").isNotNull() & F.col("__recorded").isNotNull())
    v = v.withColumn("__seen", F.greatest("__effective", "__recorded"))
    complete = F.col("__event").isNotNull() & F.col("__entity").isNotNull() & F.col("__at").isNotNull()
    known = e.where(complete)

    # One pass over both sides counts the rows of each entity: how many shards there are, and which entities are large.
    times = known.select("__entity", F.col("__at").alias("__time")).unionByName(v.select("__entity", F.col("__seen").alias("__time")))
    sizes = times.groupBy("__entity").agg(F.count("*").alias("__n"))
    total, most = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).head()
    if most <= rows_per_shard:
        known, v = known.withColumn("__cell", F.lit(-1).cast("bigint")), v.withColumn("__cell", F.lit(-1).cast("bigint"))
    else:
        large = broadcast_if_small(cut_lineage(sizes.where(F.col("__n") > rows_per_shard).select("__entity")))
        grid = broadcast_if_small(cut_lineage(_cells(times, large, span_days, rows_per_shard)))
        width = F.lit(span_days * _DAY_US)

        def placed(rows: DataFrame, time: str) -> DataFrame:
            """``rows`` with __cell, which grows with time; -1 for entities that are not large."""
            cut = rows.withColumn("__span", F.floor(F.col(time) / width)).join(grid, ["__entity", "__span"], "left")
            part = F.floor(F.pmod(F.col(time), width) / F.ceil(width / F.col("__parts")))
            return cut.withColumn("__cell", F.coalesce(F.col("__cell") * _PARTS + part, F.lit(-1)).cast("bigint")).drop("__span", "__parts")

        known, v = placed(known, "__at"), placed(v, "__seen")
        # The greatest version of each cell of a large entity, carried into every later cell that has events.
        row = F.struct("__effective", "__recorded", "__tie", "__value", "__seen")
        tops = v.where("__cell >= 0").groupBy("__entity", "__cell").agg(F.max(row).alias("__top"))
        asked = known.where("__cell >= 0").select("__entity", "__cell").distinct().withColumn("__top", F.lit(None).cast(tops.schema["__top"].dataType)).withColumn("__asks", F.lit(True))
        before = Window.partitionBy("__entity").orderBy("__cell").rangeBetween(Window.unboundedPreceding, -1)
        carried = tops.withColumn("__asks", F.lit(False)).unionByName(asked).withColumn("__carry", F.max("__top").over(before))
        carried = carried.where(F.col("__asks") & F.col("__carry").isNotNull()).select("__entity", "__cell", "__carry.*")
        v = v.select(*carried.columns).unionByName(carried)

    shards = F.lit(max(1, -(-total // rows_per_shard)))
    shard = F.pmod(F.xxhash64("__entity"), shards).cast("int").alias("__shard")
    left = known.select("*", shard).groupBy("__shard", "__cell")
    right = v.select("*", shard).groupBy("__shard", "__cell")
    kind = events.schema[event].dataType.simpleString()
    answers = left.cogroup(right).applyInPandas(_search, f"__event {kind}, __value double, __found boolean")
    unknown = e.where(~complete).select("__event", F.lit(None).cast("double").alias("__value"), F.lit(False).alias("__found"))
    out = answers.unionByName(unknown)
    return out.select(F.col("__event").alias(event), F.when(~F.isnan("__value"), F.col("__value")).alias("value"), F.col("__found").alias("found"))
