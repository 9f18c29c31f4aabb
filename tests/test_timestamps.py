"""Instants against a plain Python reading of the same texts."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from matchlake.operators.timestamps import source_zones, with_instants
from matchlake.plans import problems
from matchlake.session import table

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
FORMATS = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y%m%dT%H%M%S", "%a, %d %b %Y %H:%M:%S", "%d %b %Y %H:%M:%S", "%b %d, %Y %I:%M %p"]


def plain(text, zone, day_first):
    text = text.strip()
    if re.fullmatch(r"\d{13}", text):
        return int(text) * 1000
    if m := re.fullmatch(r"(\d{10})(?:\.(\d{1,6}))?", text):
        return int(m[1]) * 10**6 + int((m[2] or "0").ljust(6, "0"))
    rest, offset = re.sub(r"\[.*\]$", "", text), None
    if m := re.search(r"(Z|(?: ?GMT| ?UTC)?[+-]\d\d(?::?\d\d)?)$", rest) if re.search(r"\d\d:?\d\d|T\d{6}", rest) else None:
        sign = re.search(r"[+-].*", m[1])
        if not (sign and re.fullmatch(r"\d{4}-\d\d-\d\d", rest)):
            digits = re.sub(r"\D", "", m[1])
            offset = timedelta(hours=int(digits[:2] or 0), minutes=int(digits[2:4] or 0)) * (-1 if "-" in m[1] else 1)
            rest = rest[: m.start()].strip()
    abbreviation = None
    if offset is None and (m := re.search(r" ([A-Z]{3,4})$", rest)):
        abbreviation, rest = m[1], rest[: m.start()]
    micros = 0
    if m := re.search(r"(?<=:\d\d)[.,](\d{1,6})$", rest):
        micros, rest = int(m[1].ljust(6, "0")), rest[: m.start()]
    order = "%d{0}%m{0}%Y" if day_first else "%m{0}%d{0}%Y"
    for f in [*FORMATS, *[order.format(x) + y for x in "/." for y in (" %H:%M", " %H:%M:%S", " %I:%M %p")]]:
        try:
            wall = datetime.strptime(rest, f) + timedelta(microseconds=micros)
            break
        except ValueError:
            continue
    else:
        return None
    if abbreviation in ("UTC", "GMT"):
        offset = timedelta(0)
    elif abbreviation:
        z = ZoneInfo(zone)
        offset = next(d.utcoffset() for d in (datetime(wall.year, m, 1, tzinfo=z) for m in (1, 7)) if d.tzname() == abbreviation)
    if offset is None:
        local = wall.replace(tzinfo=ZoneInfo(zone), fold=0)
        if local.astimezone(timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None) != wall:
            return None
        return (local.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)
    return (wall.replace(tzinfo=timezone.utc) - offset - EPOCH) // timedelta(microseconds=1)


def test_all_texts_of_the_tables(spark, sf):
    feed = {r.provider: (r.time_zone, r.day_first) for r in table(spark, sf, "provider_feed").collect()}
    want = set()
    for r in problems._texts(spark, sf).collect():
        if r.text is not None and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", r.text):
            if (us := plain(r.text, *feed[r.provider])) is not None:
                want.add((r.table_name, r.field_name, r.row_id, us))
    got = [tuple(r) for r in problems.p3_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def instants(spark, rows, **policy):
    feed = spark.createDataFrame([("ny", "America/New_York", False), ("be", "Europe/Berlin", True), ("syd", "Australia/Sydney", True), (None, "UTC", True), ("odd", "No/Where", True)], "provider string, time_zone string, day_first boolean")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, provider string, t string").withColumn("TIME_ZONE", F.lit("clash"))
    return [r.instant_us for r in with_instants(df, "t", "provider", source_zones(feed), **policy).orderBy("id").collect()]


def us(*a):
    return (datetime(*a, tzinfo=timezone.utc) - EPOCH) // timedelta(microseconds=1)


def test_repeated_and_missing_hours(spark):
    rows = [("ny", "2024-11-03 01:30:00"), ("ny", "2024-03-10 02:30:00"), ("be", "27.10.2024 02:30"), ("ny", "3 Nov 2024 01:30:00 EST"), ("ny", "3 Nov 2024 01:30:00 EDT")]
    assert instants(spark, rows) == [us(2024, 11, 3, 5, 30), None, us(2024, 10, 27, 0, 30), us(2024, 11, 3, 6, 30), us(2024, 11, 3, 5, 30)]
    assert instants(spark, rows, ambiguous="second", nonexistent="shift")[:3] == [us(2024, 11, 3, 6, 30), us(2024, 3, 10, 7, 30), us(2024, 10, 27, 1, 30)]
    assert instants(spark, rows, ambiguous="null")[0] is None


def test_strict_parsing_and_odd_values(spark):
    bad = ["", "  ", None, "TBD", "0000-00-00 00:00:00", "2024-02-30 18:00", "2023-02-29T10:00:00Z", "24:00", "2024-01-01", "2024-01-01 25:00:00", "2024-01-01 10:61:00", "13:00 PM", "x" * 100_000, "32/01/2024 10:00", "01/01/2024 13:00 PM", "1 Feb 2024 10:00:00 XYZ"]
    assert instants(spark, [("be", t) for t in bad]) == [None] * len(bad)
    assert instants(spark, [(p, "2024-01-01 10:00:00") for p in ("unknown", "odd")]) == [None, None]
    good = [("be", " 2024-01-01T10:00:00.1234567Z "), (None, "1704103200"), ("syd", "2024-01-01T10:00:00+1100"), ("be", "1704103200123"), ("be", "1704103200.5"), ("odd", "2024-01-01T10:00:00Z"), ("ny", "12/31/2024 12:05 AM")]
    assert instants(spark, good) == [us(2024, 1, 1, 10) + 123456, us(2024, 1, 1, 10), us(2023, 12, 31, 23), us(2024, 1, 1, 10) + 123000, us(2024, 1, 1, 10) + 500000, us(2024, 1, 1, 10), us(2024, 12, 31, 5, 5)]


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        instants(spark, [], ambiguous="guess")
