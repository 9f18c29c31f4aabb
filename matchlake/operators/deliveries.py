"""Messages delivered more than once: exactly one delivery of each message is kept.

Method: exact quotient tables. The identifier of a message is written, without loss, into bytes: a head of 56 bits and
the body. A Feistel network permutes the head: its halves are XORed in turn with the xxhash64 of the other half (and of the
body, at first); each step can be undone from its own output, so the whole is a bijection and no two identifiers can meet. The top bits of the head are the quotient, its
other bits and the body are the remainder, which is stored complete. The table is Spark's hash aggregation map, keyed and
exchanged by (quotient, complete remainder): it is filled on the map side first, so a message that makes up a third of
all rows leaves each task as one row, and it spills instead of failing.

A hash map needs values of fixed width, so time of arrival and row id travel as one number of 38 digits. Its minimum, and
that of the number with the id counted down, give the smallest and the largest row id among the first arrivals of a message.
Where they are the same row, that is the one; only messages with several first arrivals are looked up again, to be told
apart by the columns between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, TimestampNTZType, TimestampType

from matchlake.session import broadcast_if_small, written

QUOTIENT_BITS = 20
HEAD_BYTES = 7
#: Messages with several first arrivals that go to every task; beyond this all rows are joined with them by a shuffle.
TIES = 50_000
_BLANKS = r"^[\s\u0000   ﻿]+|[\s\u0000   ﻿]+$"


def normalised_id(raw: Column) -> Column:
    """Identifier without surrounding blanks and regardless of case; null if nothing is left."""
    clean = F.lower(F.regexp_replace(raw, _BLANKS, ""))
    return F.when(F.length(clean) > 0, clean)


def _prefixed(part: Column) -> Column:
    """A part that can be told apart from its neighbours: its length stands before it."""
    return F.when(part.isNull(), F.lit("-")).otherwise(F.concat(F.length(part).cast("string"), F.lit(":"), part))


def with_quotient(df: DataFrame, parts: Sequence[Column], bits: int = QUOTIENT_BITS) -> tuple[DataFrame, list[str]]:
    """``df`` with quotient and complete remainder of the identifier made of ``parts``, and their column names.

    Equal quotient and remainder mean equal identifiers, and the other way round.
    """
    text = F.encode(F.concat(*[_prefixed(p) for p in parts]), "utf-8")
    # Each step is computed once: as rows of one element, they aren't copied into the expressions that use them.
    out = df.select("*", F.explode(F.array(text)).alias("__bytes"))
    head = F.conv(F.rpad(F.hex(F.substring("__bytes", 1, HEAD_BYTES)), 2 * HEAD_BYTES, "0"), 16, 10).cast("bigint")
    out = out.select("*", F.explode(F.array(F.struct(head.alias("head"), F.expr(f"substring(__bytes, {HEAD_BYTES + 1})").alias("body")))).alias("__id_"))
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    a, b = F.shiftrightunsigned(F.col("__id_.head"), 32), low(F.col("__id_.head"))
    out = out.select("*", F.explode(F.array(a.bitwiseXOR(low(F.xxhash64(b, F.col("__id_.body")))))).alias("__a"))
    out = out.select("*", F.explode(F.array(b.bitwiseXOR(low(F.xxhash64("__a"))))).alias("__b"))
    top = F.col("__a").bitwiseXOR(low(F.xxhash64("__b")))
    out = out.withColumns({"__quotient": F.shiftrightunsigned(top, 32 - bits), "__rest": F.shiftleft(top.bitwiseAND(F.lit((1 << (32 - bits)) - 1)), 32).bitwiseOR(F.col("__b")), "__body": F.col("__id_.body")})
    return out.drop("__bytes", "__id_", "__a", "__b"), ["__quotient", "__rest", "__body"]


def _order(first: Sequence[str]) -> Column:
    """Struct whose minimum is the first row in ascending order, nulls last."""
    return F.struct(*[x for c in first for x in (F.col(c).isNull().alias(f"__no_{c}"), F.col(c))])


#: Digits of a row id, and from where ids and times are counted so that none is negative. Times beyond the years 1 to 9999
#: count as the ends of that range here and are told apart with the ties.
_ID_DIGITS, _ID_ZERO, _TIME_ZERO, _TIME_TOP = 20, 2**63, 62_135_596_800_000_000, 10**18 - 1


def _whole(n: int, digits: int) -> Column:
    return F.lit(str(n)).cast(f"decimal({digits},0)")


def _number(at: Column, row: Column, down: bool = False) -> Column:
    """Arrival and row id as one number; an unknown arrival is the last. ``down``: ids counted from their largest."""
    time = F.when(at.isNull(), F.lit(_TIME_TOP)).otherwise(F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(_TIME_TOP - 1), F.greatest(at, F.lit(-_TIME_ZERO)) + F.lit(_TIME_ZERO))))
    code = row.cast("decimal(20,0)") + _whole(_ID_ZERO, 20)
    code = _whole(10**_ID_DIGITS - 1, 20) - code if down else code
    return (time.cast("decimal(18,0)") * _whole(10**_ID_DIGITS, 21) + code.cast("decimal(20,0)")).cast("decimal(38,0)")


def _row_of(number: Column, down: bool = False) -> Column:
    code = F.pmod(number, _whole(10**_ID_DIGITS, 21)).cast("decimal(20,0)")
    code = _whole(10**_ID_DIGITS - 1, 20) - code if down else code
    return (code - _whole(_ID_ZERO, 20)).cast("bigint")


def _first_of_each(named: DataFrame, names: list[str], order: Sequence[str]) -> DataFrame:
    """The row ids of the first deliveries, by a hash table; order: a timestamp, any columns, an integral row id."""
    at, row = F.unix_micros(F.col(order[0]).cast("timestamp")), F.col(order[-1]).cast("bigint")
    table = written(named.groupBy(*names).agg(F.min(_number(at, row)).alias("__low"), F.min(_number(at, row, True)).alias("__high"), F.count(row).alias("__ids"), F.count("*").alias("__rows")))
    settled = (_row_of(F.col("__low")) == _row_of(F.col("__high"), True)) & (F.col("__ids") == F.col("__rows"))
    first = table.where(settled).select(_row_of(F.col("__low")).alias(order[-1]))
    if (tied := table.where(~F.coalesce(settled, F.lit(False))).select(*names)).isEmpty():
        return first
    again = named.join(broadcast_if_small(tied, TIES), names, "left_semi").groupBy(*names).agg(F.min(_order(order)).alias("__first"))
    return first.unionByName(again.select(F.col("__first").getField(order[-1]).cast("bigint").alias(order[-1])))


def kept_deliveries(
    df: DataFrame,
    key: Sequence[str] = ("provider", "record_type"),
    id_column: str = "provider_record_id",
    order: Sequence[str] = ("fetched_at", "source_batch_id", "delivery_id"),
) -> DataFrame:
    """One row for each message: the last of the ``order`` columns, the row id, of its first delivery.

    Nulls in ``key`` are a value like any other; null ``order`` values come last. A row whose identifier is null
    or blank names no message: it is its own message and is kept. Repeated equal rows count once. If the first order
    column is no timestamp or the row id no integer, the first delivery is found by comparing the columns themselves.
    """
    row_id = order[-1]
    base = df.select(*[F.col(c) for c in dict.fromkeys([*key, id_column, *order])]).withColumn("__id", normalised_id(F.col(id_column)))
    named, names = with_quotient(base.where(F.col("__id").isNotNull()), [*[F.col(c) for c in key], F.col("__id")])
    kinds = [df.schema[c].dataType for c in (order[0], row_id)]
    if isinstance(kinds[0], (TimestampType, TimestampNTZType)) and isinstance(kinds[1], (LongType, IntegerType)):
        kept = _first_of_each(named, names, order).select(F.col(row_id).cast(kinds[1]).alias(row_id))
    else:
        kept = named.groupBy(*names).agg(F.min(_order(order)).alias("__first")).select(F.col("__first").getField(row_id).alias(row_id))
    return kept.unionByName(base.where(F.col("__id").isNull()).select(row_id).distinct())


def dropped_deliveries(df: DataFrame, row_id: str = "delivery_id", **how) -> DataFrame:
    """The row ids of the deliveries that are not kept, distinct. ``row_id`` must be among the order columns."""
    kept = kept_deliveries(df, **how)
    return df.select(row_id).where(F.col(row_id).isNotNull()).distinct().join(kept, row_id, "left_anti")


def deduplicated(df: DataFrame, row_id: str = "delivery_id", **how) -> DataFrame:
    """``df`` with exactly one row for each message, all its columns kept.

    Where equal rows repeat with the same row id, one of them stays.
    """
    kept = kept_deliveries(df, **how).select(F.col(row_id).alias("__kept")).distinct()
    return df.dropDuplicates([row_id]).join(kept, F.col(row_id).eqNullSafe(F.col("__kept")), "left_semi")
