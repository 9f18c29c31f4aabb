"""Datasets written as JSON Lines, CSV or Parquet: nested columns flattened to dotted names in alphabetical order."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DoubleType, FloatType, MapType, StructType, TimestampType

from matchlake.functions.columns import binary_round

PRECISION = 6


def _leaves(kind: StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], DataType]]:
    out = []
    for f in kind.fields:
        at = (*path, f.name)
        out += _leaves(f.dataType, at) if isinstance(f.dataType, StructType) else [(at, f.dataType)]
    return out


def flatten(df: DataFrame, precision: int = PRECISION) -> DataFrame:
    """Every leaf of nested structs as a column with its dotted name, sorted. Lists stay lists; floats are rounded."""
    columns: list[tuple[str, Column]] = []
    for path, kind in _leaves(df.schema):
        value = F.col(f"`{path[0]}`")
        for part in path[1:]:
            value = value.getField(part)
        columns.append((".".join(path), binary_round(value, precision) if isinstance(kind, (DoubleType, FloatType)) else value))
    return df.select(*[c.alias(n) for n, c in sorted(columns, key=lambda x: x[0])])


def _text(df: DataFrame, name: str) -> Column:
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (ArrayType, MapType)):
        return F.to_json(value)
    if isinstance(kind, TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return value.cast("string") if not isinstance(kind, DateType) else F.date_format(value, "yyyy-MM-dd")


def json_lines(df: DataFrame, order: list[str] | None = None, precision: int = PRECISION) -> DataFrame:
    """One text column: each row as a JSON object with sorted keys, nulls included; sorted by ``order`` if given."""
    flat = flatten(df, precision)
    rows = flat.orderBy(*[F.col(f"`{c}`") for c in order]) if order else flat
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in flat.columns]), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A folder of JSON Lines parts, in order over the parts. The commit is the writer's: all or nothing."""
    json_lines(df, order).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A folder of CSV parts with a header: nulls empty, lists and maps as JSON."""
    flat = flatten(df)
    rows = flat.orderBy(*[F.col(f"`{c}`") for c in order]) if order else flat
    rows.select(*[F.coalesce(_text(flat, c), F.lit("")).alias(c) for c in flat.columns]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_report(report: dict, path: str) -> None:
    """A small report as indented JSON with sorted keys, replaced in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True, default=str)
        f.write("\n")
    os.replace(f.name, path)


def report_text(report: dict) -> str:
    """Lines of name and value, sorted, without nulls; fractions with three digits."""
    return "\n".join(f"{k}: {v:.3f}" if isinstance(v, float) else f"{k}: {v}" for k, v in sorted(report.items()) if v is not None)
