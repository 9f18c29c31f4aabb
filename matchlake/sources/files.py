"""Raw messages out of JSON Lines and CSV files, and a pageable view of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from matchlake.functions.columns import canonical_json, short_hash
from matchlake.session import broadcast_if_small


class SourceReadError(ValueError):
    """A file holds what its format does not allow."""


class _Ranges(DataSourceReader):
    """Lines of byte ranges; a line belongs to the range its first byte is in. Only sizes are read on the driver."""

    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self):
        import os

        return [InputPartition((path, k, begin, min(begin + self.size, total))) for path in self.paths for total in [os.path.getsize(path)] for k, begin in enumerate(range(0, max(total, 1), self.size))]

    def read(self, partition) -> Iterator[tuple]:
        path, k, begin, end = partition.value
        number = 0
        with open(path, "rb") as f:
            if begin:
                f.seek(begin - 1)
                f.readline()
            while f.tell() < end:
                line = f.readline()
                if not line:
                    break
                number += 1
                yield path, k, number, line.decode("utf-8", "replace").rstrip("\r\n")


class NumberedLines(DataSource):
    """``spark.read.format("numbered_lines").load(path)``: file, range, line (from 1 within the range) and text of each line of
    local or mounted files.

    Options: path (several joined by a comma), bytes (size of a range, 64 MiB).
    """

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "file string, range int, line bigint, text string"

    def reader(self, schema):
        return _Ranges([p for p in self.options["path"].split(",") if p], int(self.options.get("bytes", 64 << 20)))


def numbered_lines(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """(file, line, text) with lines counted from 1 within each file: tasks count the lines of their ranges, and each range is
    moved on by those before it."""
    spark.dataSource.register(NumberedLines)
    rows = spark.read.format("numbered_lines").option("bytes", range_bytes).load(path)
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("file", "range").agg(F.count("*").alias("__n")).select("file", "range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return rows.join(broadcast_if_small(base), ["file", "range"]).select("file", (F.col("line") + F.col("__base")).alias("line"), "text")


def _raw(rows: DataFrame, provider: str, record_type: str, id_field: str, name: str) -> DataFrame:
    """Raw messages of payloads; without an id the number of the row within its file, from 0, is the id."""
    own = F.get_json_object("payload", f"$['{id_field}']")
    now = F.current_timestamp()
    return rows.select(
        F.lit(provider).alias("provider"), F.coalesce(own, F.col("row").cast("string")).alias("provider_record_id"), F.lit(record_type).alias("record_type"), "payload",
        F.lit(f"{name}:0").alias("source_batch_id"), now.alias("source_timestamp"), now.alias("fetched_at"), "row",
    )


def read_jsonl(spark: SparkSession, path: str, provider: str, record_type: str, id_field: str = "id", strict: bool = True, range_bytes: int = 64 << 20) -> DataFrame:
    """Messages of a JSON Lines file: one object a line; blank lines are skipped and not counted as rows.

    A line that is no object raises SourceReadError with its file and number if ``strict``, else is left out.
    """
    lines = numbered_lines(spark, path, range_bytes).where(F.length(F.trim("text")) > 0)
    good = F.trim("text").startswith("{") & F.expr("try_parse_json(text)").isNotNull()
    if strict and (bad := lines.where(~F.coalesce(good, F.lit(False))).orderBy("file", "line").select("file", "line").head(1)):
        raise SourceReadError(f"{bad[0].file}:{bad[0].line}: not a JSON object")
    kept = lines.where(good).withColumn("payload", F.trim("text"))
    return _raw(_numbered(kept), provider, record_type, id_field, path)


def _numbered(lines: DataFrame) -> DataFrame:
    """Rows counted from 0 within each file, in two levels: spans of lines first, then inside a span."""
    span = F.floor(F.col("line") / 10_000)
    rows = lines.withColumn("__span", span)
    counts = rows.groupBy("file", "__span").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("file").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("file", "__span", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("file", "__span").orderBy("line")
    return rows.join(base, ["file", "__span"]).withColumn("row", F.col("__base") + F.row_number().over(inside) - 1).drop("__span", "__base")


def read_csv(spark: SparkSession, path: str, provider: str, record_type: str, id_field: str = "id", delimiter: str = ",", strict: bool = True, multiline: bool = False) -> DataFrame:
    """Messages of a CSV file with a header: all values are texts, short rows have nulls at their end.

    A row wider than the header raises SourceReadError if ``strict``, else loses its surplus. A file without a header
    raises. ``multiline``: quoted fields may span lines; such a file can't be cut and is read by one task, its rows numbered
    as they come, so it is for files that one task can read.
    """
    if multiline:
        return _read_whole_csv(spark, path, provider, record_type, id_field, delimiter, strict)
    lines = numbered_lines(spark, path).where(F.length(F.trim("text")) > 0)
    head = lines.where("line = 1").select("text").head(1)
    if not head:
        raise SourceReadError(f"{path}: no header")
    import csv

    names = next(csv.reader([head[0].text], delimiter=delimiter))
    if not all(n.strip() for n in names) or len(set(names)) < len(names):
        raise SourceReadError(f"{path}: header has empty or repeated names")
    schema = ", ".join(f"`c{i}` string" for i in range(len(names) + 1))
    parsed = lines.where("line > 1").withColumn("v", F.from_csv("text", schema, {"sep": delimiter, "mode": "PERMISSIVE"}))
    if strict and (bad := parsed.where(F.col(f"v.c{len(names)}").isNotNull()).orderBy("file", "line").select("file", "line").head(1)):
        raise SourceReadError(f"{bad[0].file}:{bad[0].line}: wider than the header")
    payload = F.to_json(F.struct(*[F.col(f"v.c{i}").alias(n) for i, n in enumerate(names)]), {"ignoreNullFields": "false"})
    return _raw(_numbered(parsed.withColumn("payload", payload)), provider, record_type, id_field, path)


def _read_whole_csv(spark: SparkSession, path: str, provider: str, record_type: str, id_field: str, delimiter: str, strict: bool) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import json

        for batch in batches:
            for file in batch["file"]:
                with open(file, newline="", encoding="utf-8", errors="replace") as f:
                    reader = csv.reader(f, delimiter=delimiter)
                    names = next(reader, None)
                    if not names or not all(n.strip() for n in names) or len(set(names)) < len(names):
                        raise SourceReadError(f"{file}: no header, or one with empty or repeated names")
                    part = []
                    for values in reader:
                        if not any(v.strip() for v in values):
                            continue
                        if strict and len(values) > len(names):
                            raise SourceReadError(f"{file}:{reader.line_num}: wider than the header")
                        filled = dict(zip(names, [*values, *[None] * (len(names) - len(values))]))
                        part.append((file, reader.line_num, json.dumps(filled, ensure_ascii=False)))
                        if len(part) >= 10_000:
                            yield pd.DataFrame(part, columns=["file", "line", "payload"])
                            part = []
                    yield pd.DataFrame(part, columns=["file", "line", "payload"])

    files = spark.createDataFrame([(p,) for p in path.split(",") if p], "file string")
    parsed = files.repartition("file").mapInPandas(rows, "file string, line bigint, payload string")
    return _raw(_numbered(parsed), provider, record_type, id_field, path)


def page(raw: DataFrame, cursor: str | None, size: int = 100, name: str = "file") -> tuple[DataFrame, str | None]:
    """(rows of one batch, cursor of the next or None). The cursor is the number of the first row not yet read."""
    first = int(cursor or 0)
    batch = raw.where((F.col("row") >= first) & (F.col("row") < first + size)).withColumn("source_batch_id", F.lit(f"{name}:{first}"))
    more = not raw.where(F.col("row") >= first + size).isEmpty()
    return batch, str(first + size) if more else None


def batch_checksum(batch: DataFrame) -> DataFrame:
    """One row: the first 16 hexadecimal digits of the SHA-256 of the batch's canonical payloads, in order.

    A batch is a page of bounded size, so its payloads fit one row.
    """
    parts = batch.select("row", canonical_json("payload").alias("j")).agg(F.sort_array(F.collect_list(F.struct("row", "j"))).alias("all"))
    return parts.select(short_hash(F.concat_ws("|", F.transform("all", lambda x: x["j"]))).alias("checksum"))


def health(spark: SparkSession, path: str, name: str = "file") -> DataFrame:
    """(source, healthy, detail, checked_at) of a file source: one row."""
    there = healthy(spark, path)
    return spark.range(1).select(F.lit(name).alias("source"), F.lit(there).alias("healthy"), F.lit(None if there else f"{path} does not exist").cast("string").alias("detail"), F.current_timestamp().alias("checked_at"))


def healthy(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in its file system, local or not."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
