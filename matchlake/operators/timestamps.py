"""Mixed timestamp formats and zones, normalised to one UTC instant.

Method: an ordered cascade of anchored patterns. The first pattern whose whole regular expression matches a
value decides it; its groups give the fields, which are then checked strictly (no 30 February, no hour 25).
A value without a zone takes the source's zone from a lookup, and policies say what becomes of local times that
occur twice or never. Everything is built-in expressions, so the work stays in generated JVM code.
"""

from __future__ import annotations

import zoneinfo
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType

from matchlake.session import broadcast_if_small

_YMD = r"(\d{4})-(\d{2})-(\d{2})"
_HMS = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_OFFSET = r"(Z|z|[+-]\d{2}(?::?\d{2})?)"
_DAY_NAME = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? )?"
_MONTH = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_MONTH_LONG = _MONTH[:-1] + r")[a-z]*\.?"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Already in the one normal form; such a value needs no repair.
NORMAL_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


@dataclass(frozen=True)
class Pattern:
    """An anchored pattern; ``groups`` name what each group of the expression holds.

    y, mo, d, h, mi, s, frac, ampm, mon (month name), off (offset), abbr (zone abbreviation), p1/p2 (day and
    month in the order of the source) or sec (seconds since 1970), with frac.
    """

    name: str
    regex: str
    groups: tuple[str, ...]


PATTERNS: tuple[Pattern, ...] = (
    Pattern("iso_offset", rf"^{_YMD}[T ]{_HMS} ?{_OFFSET}(?:\[[^\]]+\])?$", ("y", "mo", "d", "h", "mi", "s", "frac", "off")),
    Pattern("iso_local", rf"^{_YMD}[T ]{_HMS}$", ("y", "mo", "d", "h", "mi", "s", "frac")),
    Pattern("iso_abbreviation", rf"^{_YMD}[T ]{_HMS} ([A-Za-z]{{2,5}})$", ("y", "mo", "d", "h", "mi", "s", "frac", "abbr")),
    Pattern("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_OFFSET}$", ("y", "mo", "d", "h", "mi", "s", "frac", "off")),
    Pattern("compact_local", r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?$", ("y", "mo", "d", "h", "mi", "s", "frac")),
    Pattern("epoch_micros", r"^(\d{10})(\d{6})$", ("sec", "frac")),
    Pattern("epoch_millis", r"^(\d{10})(\d{3})$", ("sec", "frac")),
    Pattern("epoch_seconds", r"^(\d{9,10})(?:\.(\d{1,9}))?$", ("sec", "frac")),
    Pattern("numeric_12h", rf"^(\d{{1,2}})[/.](\d{{1,2}})[/.](\d{{4}}),? (\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))? ?([AaPp])\.?[Mm]\.?$", ("p1", "p2", "y", "h", "mi", "s", "ampm")),
    Pattern("numeric_local", rf"^(\d{{1,2}})[/.](\d{{1,2}})[/.](\d{{4}}),? {_HMS}$", ("p1", "p2", "y", "h", "mi", "s", "frac")),
    Pattern("rfc_offset", rf"^{_DAY_NAME}(\d{{1,2}}) {_MONTH} (\d{{4}}) {_HMS} (?:GMT|UTC)?{_OFFSET}$", ("d", "mon", "y", "h", "mi", "s", "frac", "off")),
    Pattern("rfc_abbreviation", rf"^{_DAY_NAME}(\d{{1,2}}) {_MONTH} (\d{{4}}) {_HMS} ([A-Za-z]{{2,5}})$", ("d", "mon", "y", "h", "mi", "s", "frac", "abbr")),
    Pattern("rfc_local", rf"^{_DAY_NAME}(\d{{1,2}}) {_MONTH} (\d{{4}}) {_HMS}$", ("d", "mon", "y", "h", "mi", "s", "frac")),
    Pattern("english_12h", rf"^{_MONTH_LONG} (\d{{1,2}}),? (\d{{4}}),? (\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))? ?([AaPp])\.?[Mm]\.?$", ("mon", "d", "y", "h", "mi", "s", "ampm")),
    Pattern("english_local", rf"^{_MONTH_LONG} (\d{{1,2}}),? (\d{{4}}),? {_HMS}$", ("mon", "d", "y", "h", "mi", "s", "frac")),
)


def _abbreviations(name: str | None) -> dict[str, int]:
    """Offset in seconds of each abbreviation the IANA zone ``name`` has used since 1970; UTC and GMT always.

    An unknown zone gets the mark "?".
    """
    known = {"UTC": 0, "GMT": 0, "Z": 0, "UT": 0}
    if name:
        try:
            zone = zoneinfo.ZoneInfo(name)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
            return known | {"?": 0}
        at, end = datetime(1970, 1, 1, tzinfo=timezone.utc), datetime(2038, 1, 1, tzinfo=timezone.utc)
        while at < end:  # the latest meaning of an abbreviation wins
            local = at.astimezone(zone)
            if local.tzname().isalpha():
                known[local.tzname().upper()] = int(local.utcoffset().total_seconds())
            at += timedelta(days=14)
    return known


@F.pandas_udf(MapType(StringType(), IntegerType()))
def zone_abbreviations(zones: pd.Series) -> pd.Series:
    found = {z: _abbreviations(z) for z in zones.unique()}
    return zones.map(found.__getitem__)


def source_zones(feed: DataFrame, source: str = "provider", zone: str = "time_zone", day_first: str = "day_first") -> DataFrame:
    """The lookup of a source's zone, numeric date order and zone abbreviations; one row a source."""
    rows = feed.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("__source"))
    rows = rows.agg(F.min(zone).alias("__zone"), F.min(day_first).alias("__day_first"))
    rows = rows.withColumn("__abbr", zone_abbreviations("__zone"))
    return rows.withColumn("__zone", F.when(~F.map_contains_key("__abbr", "?"), F.col("__zone")))


_SLOTS = ("y", "mo", "d", "p1", "p2", "mon", "h", "mi", "s", "frac", "ampm", "off", "abbr", "sec")


def _template(p: Pattern) -> str:
    """Replacement that writes a pattern's groups into the common slots, then whether the value has a zone."""
    slots = [f"${p.groups.index(x) + 1}" if x in p.groups else "" for x in _SLOTS]
    return "|".join([*slots, "zoned" if {"off", "abbr", "sec"} & set(p.groups) else "local"])


def _cascade(value: Column, patterns: tuple[Pattern, ...]) -> Column:
    """The slots of the first pattern that matches, as one text; null if none does."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(value.rlike(p.regex), F.regexp_replace(value, F.lit(p.regex), F.lit(_template(p)))).otherwise(out)
    return out


def _parts() -> dict[str, Column]:
    """Checked numbers out of the slots in __slots."""
    text = {x: F.col("__slots")[i] for i, x in enumerate(_SLOTS)}
    number = {x: F.when(text[x] != "", text[x]).cast("int") for x in ("y", "mo", "d", "p1", "p2", "h", "mi", "s")}
    month_name = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(text["mon"])).cast("int")
    first = F.when(F.col("__day_first").isNotNull(), F.col("__day_first"))
    month = F.coalesce(number["mo"], F.when(text["mon"] != "", month_name), F.when(first, number["p2"]).when(~first, number["p1"]))
    day = F.coalesce(number["d"], F.when(first, number["p1"]).when(~first, number["p2"]))
    twelve = F.when(number["h"].between(1, 12), number["h"] % 12)
    hour = F.when(text["ampm"] == "", number["h"]).when(F.lower(text["ampm"]) == "p", twelve + 12).otherwise(twelve)
    digits = F.regexp_replace(text["off"], "[^0-9]", "")
    sign = F.when(text["off"].startswith("-"), -1).otherwise(1)
    ahead = F.substring(digits, 1, 2).cast("int") * 3600 + F.when(F.length(digits) == 4, F.substring(digits, 3, 2).cast("int") * 60).otherwise(0)
    offset = (
        F.when(text["abbr"] != "", F.try_element_at("__abbr", F.upper(text["abbr"])))
        .when(digits != "", F.when(ahead <= 18 * 3600, sign * ahead))
        .when(text["off"] != "", 0)
    )
    return {
        "y": number["y"], "mo": month, "d": day, "h": hour, "mi": number["mi"], "s": F.coalesce(number["s"], F.lit(0)),
        "us": F.when(text["frac"] == "", 0).otherwise(F.rpad(F.substring(text["frac"], 1, 6), 6, "0").cast("int")),
        "off": offset, "sec": F.when(text["sec"] != "", text["sec"]).cast("bigint"), "local": F.col("__slots")[len(_SLOTS)] == "local",
    }


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that the optimizer computes once, here: it copies no expression past an explode."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_instants(
    df: DataFrame,
    value: str,
    source: str,
    zones: DataFrame,
    out: str = "instant_us",
    ambiguous: str = "first",
    nonexistent: str = "null",
    patterns: tuple[Pattern, ...] = PATTERNS,
) -> DataFrame:
    """``df`` with the microseconds since 1970-01-01 UTC that the text in ``value`` denotes, else null.

    ``zones`` comes from ``source_zones``. ``ambiguous``: "first" or "second" pass of a repeated local hour, or
    "null". ``nonexistent``: "null", or "shift" (moved forward by the gap) for local times that a clock change
    skips. Null, empty and unreadable values, impossible dates, dates alone, and local times of a source that
    the lookup doesn't know give null. Digits beyond microseconds are cut off. Other columns stay as they are.
    """
    if ambiguous not in ("first", "second", "null") or nonexistent not in ("null", "shift"):
        raise ValueError("unknown policy")
    joined = df.join(broadcast_if_small(zones), df[source] == F.col("__source"), "left")
    rows = joined.withColumn("__v", F.trim(df[value]))
    rows = _once(rows, "__slots", F.split(_cascade(F.col("__v"), patterns), r"\|", -1))
    rows = _once(rows, "__p", F.when(F.col("__slots").isNotNull(), F.struct(*[c.alias(n) for n, c in _parts().items()])))
    p = F.col("__p")
    strict = p["mi"].between(0, 59) & p["s"].between(0, 59) & p["h"].between(0, 23) & (p["y"] > 0)
    seconds = p["s"].cast("decimal(16,6)") + p["us"].cast("decimal(16,6)") / F.lit(1_000_000).cast("decimal(16,6)")
    rows = rows.withColumn("__wall", F.when(strict, F.try_make_timestamp_ntz(p["y"], p["mo"], p["d"], p["h"], p["mi"], seconds.cast("decimal(16,6)"))))
    # The wall time is moved between zones as a timestamp without zone, so the session's zone plays no part.
    local = "case when __p.local then convert_timezone(__zone, 'UTC', __wall) end"
    rows = rows.withColumn("__utc", F.expr(local))
    rows = rows.withColumn("__exists", F.expr("convert_timezone('UTC', __zone, __utc) = __wall"))
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")
    found = micros("__utc")
    if nonexistent == "null":
        found = F.when(F.col("__exists"), found)
    if ambiguous != "first":
        again = F.lit(None).cast("int")
        for minutes in (30, 60, 120):
            later = f"convert_timezone('UTC', __zone, __utc + interval {minutes} minutes) = __wall"
            again = F.when(F.expr(later), minutes).otherwise(again)
        rows = rows.withColumn("__again", F.when(F.col("__exists"), again))
        found = F.when(F.col("__again").isNull(), found).otherwise(found + F.col("__again").cast("bigint") * 60_000_000 if ambiguous == "second" else F.lit(None))
    instant = (
        F.when(p["sec"].isNotNull(), p["sec"] * 1_000_000 + p["us"])
        .when(p["local"], found)
        .when(p["off"].isNotNull(), micros("__wall") - p["off"].cast("bigint") * 1_000_000)
    )
    return _once(rows, out, instant).select(*df.columns, out)


def is_normal_form(value: Column) -> Column:
    return value.rlike(NORMAL_FORM)
