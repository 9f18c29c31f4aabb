"""Rows brought together by a key as compressed Arrow tables, for many narrow rows whose keys are of bounded size.

Spark's exchange writes every value in eight bytes and compresses row by row, so that numbers of one or two bytes take five.
Here the rows of many keys travel as one table: integers in the narrowest type that holds them, columns compressed as such.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A task sends its rows on whenever it has so many; a part holds about so many, whatever the number of shuffle partitions.
PACKED, PART = 200_000, 200_000


def parts_for(df: DataFrame, rows: int) -> int:
    """The number of parts for so many rows: that of the shuffle partitions, or more where parts would be too large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART))


def _narrow(column: pa.ChunkedArray) -> pa.ChunkedArray:
    if not pa.types.is_integer(column.type) or column.null_count == len(column):
        return column
    low, high = (pc.min_max(column)[x].as_py() for x in ("min", "max"))
    return column.cast(next(t for t, bits in ((pa.int8(), 7), (pa.int16(), 15), (pa.int32(), 31), (pa.int64(), 63)) if -(2**bits) <= low and high < 2**bits))


def _packs(table: pa.Table) -> pa.RecordBatch:
    """A row for each part in ``table`` (its last column): part and the rest of its rows."""
    part = table["__part"].to_numpy()
    order = np.argsort(part, kind="stable")
    rows = table.drop_columns("__part").take(pa.array(order)).combine_chunks()
    rows = pa.table([_narrow(c) for c in rows.columns], rows.column_names)
    at, first = np.unique(part[order], return_index=True)
    out = []
    for low, high in zip(first, [*first[1:], len(order)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(rows.slice(low, high - low))
        out.append(sink.getvalue().to_pybytes())
    return pa.record_batch([pa.array(at, pa.int32()), pa.array(out, pa.binary())], ["part", "rows"])


def by_part(df: DataFrame, key: Column, parts: int, then: Callable[[pa.Table], Iterator[pa.Table]], schema: StructType) -> DataFrame:
    """What ``then`` makes of all rows of each part, with the columns of ``schema``; rows of one key are in one part.

    A part is held in memory, so no key may have more rows than fit there.
    """
    given = to_arrow_schema(df.schema)
    wanted = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield _packs(pa.Table.from_batches(held))
                held = []
        if held and sum(b.num_rows for b in held):
            yield _packs(pa.Table.from_batches(held))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.ipc.open_stream(x.as_buffer()).read_all().cast(given) for batch in batches for x in batch["rows"]]
        if tables:
            for made in then(pa.concat_tables(tables)):
                yield from made.select(wanted.names).cast(wanted).combine_chunks().to_batches(10_000)

    rows = df.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    packed = rows.mapInArrow(pack, "part int, rows binary")
    return packed.repartitionById(parts, F.col("part")).mapInArrow(unpack, schema)
