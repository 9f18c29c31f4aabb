import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from matchlake.operators.known_at import known_at

T0 = datetime(2020, 1, 1)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def run(spark, events, versions, **how):
    e = spark.createDataFrame(events, "event bigint, who string, at timestamp").withColumn("__SEEN", F.lit("clash"))
    v = spark.createDataFrame(versions, "id bigint, who string, value int, eff timestamp, rec timestamp").withColumn("__span", F.lit("clash"))
    out = known_at(e, v, event="event", entity="who", at="at", version_entity="who", value="value", effective="eff", recorded="rec", tie="id", **how)
    return {(r.event, r.value, r.found) for r in out.collect()}


def plain(events, versions):
    out = set()
    for i, who, at in events:
        seen = [(e, r, v) for _, w, v, e, r in versions if who is not None and w == who and at and e and r and e < at and r < at]
        best = max(seen, key=lambda s: s[:2], default=None)
        out.add((i, best[2] if best else None, best is not None))
    return out


def test_against_every_pair(spark):
    rng = random.Random(5)
    when = [None, *range(0, 900, 3)]
    who = ["a", "b", "c", None, "hot", "hot", "hot"]
    versions, used = [], set()
    for i in range(400):
        w, e, r = rng.choice(who), rng.choice(when), rng.choice(when)
        if (w, e, r) not in used:  # full ties are settled by a hash
            used.add((w, e, r))
            versions.append((i, w, rng.choice([None, *range(100)]), day(e), day(r)))
    events = [(i, rng.choice([*who, "new"]), day(rng.choice(when))) for i in range(400)]
    want = plain(events, versions)
    for how in ({}, {"rows_per_shard": 100}, {"span_days": 7, "rows_per_shard": 50}, {"span_days": 100_000, "rows_per_shard": 20}, {"span_days": 30, "rows_per_shard": 10}):
        assert run(spark, events, versions, **how) == want


def test_strictly_before_and_late_corrections(spark):
    versions = [(1, "a", 10, day(10), day(10)), (2, "a", 11, day(10), day(20)), (3, "a", 9, day(5), day(30))]
    events = [(n, "a", day(n)) for n in (10, 11, 20, 21, 31)]
    assert run(spark, events, versions) == {(10, None, False), (11, 10, True), (20, 10, True), (21, 11, True), (31, 11, True)}


def test_empty_sides_and_repeated_rows(spark):
    assert run(spark, [], [(1, "a", 1, day(1), day(1))]) == set()
    assert run(spark, [(1, "a", day(3)), (1, "a", day(3))], []) == {(1, None, False)}
    assert run(spark, [(1, "a", day(3))], [(1, "a", 1, day(1), day(1))] * 3) == {(1, 1.0, True)}


def test_a_large_entity_is_cut_into_cells(spark):
    """No cell of an entity with nearly all rows holds much more than a shard's rows, even if they fall on one day."""
    from matchlake.operators import known_at as k

    rows = [("hot", n * 60_000_000) for n in range(1440)] + [("hot", (10 + n) * k._DAY_US) for n in range(100)] + [("cold", 5)]
    times = spark.createDataFrame(rows, "__entity string, __time bigint")
    large = spark.createDataFrame([("hot",)], "__entity string")
    grid = {(r["__entity"], r["__span"]): (r["__cell"], r["__parts"]) for r in k._cells(times, large, 1, 100).collect()}
    assert ("cold", 0) not in grid and grid["hot", 0] == (0, 15) and grid["hot", 10] == (14, 1) and max(c for c, _ in grid.values()) == 15
