"""The latest row of a key before (or at) a time.

Rows and questions share one time line per key; the running maximum of (time, tie, values) along it answers each
question. It is made in two levels, blocks of time and then inside a block, so no key is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.columns import DAY_US

BLOCK_DAYS = 30


def latest(rows: DataFrame, probes: DataFrame, key: Sequence[str], values: Sequence[str], tie: str, inclusive: bool = False, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(probe, at, values...) for each probe: the values of the key's row with the latest (at, tie) before it.

    ``rows``: key, at (microseconds), tie, values; ``probes``: key, at, probe. ``inclusive``: rows at the probe's own
    time count too. Probes without such a row, or with a null key or time, get nulls. Values may be null.
    """
    one = F.struct(F.col("at").alias("__at"), F.col(tie).alias("__tie"), *[F.col(v).alias(f"__v_{v}") for v in values])
    have = rows.where(F.col("at").isNotNull()).select(*key, "at", F.lit(0 if inclusive else 1).alias("__late"), one.alias("__row"), F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"), F.lit(False).alias("__ask"))
    ask = probes.select(*key, "at", F.lit(1 if inclusive else 0).alias("__late"), F.lit(None).cast(have.schema["__row"].dataType).alias("__row"), "probe", F.lit(True).alias("__ask"))
    usable = F.col("at").isNotNull()
    for k in key:
        usable = usable & F.col(k).isNotNull()
    both = have.unionByName(ask.where(usable)).withColumn("__block", F.floor(F.col("at") / F.lit(block_days * DAY_US)))
    tops = both.groupBy(*key, "__block").agg(F.max("__row").alias("__top"))
    earlier = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = tops.select(*key, "__block", F.max("__top").over(earlier).alias("__base"))
    inside = Window.partitionBy(*key, "__block").orderBy("at", "__late").rowsBetween(Window.unboundedPreceding, 0)
    found = both.join(base, [*key, "__block"]).withColumn("__best", F.coalesce(F.max("__row").over(inside), F.col("__base"))).where("__ask")
    out = found.select("probe", "at", *[F.col(f"__best.__v_{v}").alias(v) for v in values])
    return out.unionByName(ask.where(~usable).select("probe", "at", *[F.lit(None).cast(rows.schema[v].dataType).alias(v) for v in values]))
