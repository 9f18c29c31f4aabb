import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from matchlake.operators import references as R

T0 = datetime(2024, 1, 1)
TARGET = "provider string, key string, arrived timestamp, withdrawn timestamp"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def frames(spark, refs, targets):
    r = spark.createDataFrame(refs, "row_id bigint, provider string, k string, arrived timestamp").withColumn("FIELD_NAME", F.lit("clash"))
    t = spark.createDataFrame(targets, TARGET)
    made = R.reference_rows(r, "t", "row_id", F.col("provider"), F.col("arrived"), [R.Reference("k", "x")])
    return made, R.target_rows(t, "x", F.col("provider"), F.col("key"), F.col("arrived"), F.col("withdrawn"))


def plain(refs, targets):
    out = set()
    for i, p, k, at in refs:
        if k is None or not k.strip():
            continue
        if not any(p is not None and p == q and k == key and a is not None and at is not None and a <= at and (w is None or w > at) for q, key, a, w in targets):
            out.add(i)
    return out


def test_against_every_pair(spark):
    rng = random.Random(11)
    keys = ["a", "A", " a", "b", "c", "hot", "", " ", None]
    for _ in range(3):
        refs = [(i, rng.choice(["p", "q", None]), rng.choice(keys + ["hot"] * 6), day(rng.choice([None, *range(0, 200, 5)]))) for i in range(300)]
        targets = [(rng.choice(["p", "q", None]), rng.choice(keys + ["hot"] * 6), day(rng.choice([None, *range(0, 200, 5)])), day(rng.choice([None, None, *range(0, 200, 5)]))) for _ in range(25)]
        made, there = frames(spark, refs, targets)
        for days in (1, 30, 1000):
            assert {r.row_id for r in R.orphan_references(made, there, days).collect()} == plain(refs, targets)


def test_counts_along_time_and_one_key_on_a_third_of_the_rows(spark):
    refs = [(i, "p", "hot", day(i % 50)) for i in range(300)] + [(1000 + i, "p", f"k{i}", day(3)) for i in range(600)]
    targets = [("p", "hot", day(10), day(20)), ("p", "hot", day(15), day(30)), ("p", "k1", day(3), None), ("p", "k2", day(4), None)]
    made, there = frames(spark, refs, targets)
    counts = {(r.key, r.at): r.refs for r in R.orphan_instants(made, there).collect()}
    assert all(counts["hot", day(n)] == 6 for n in (0, 9, 30, 49)) and not any(("hot", day(n)) in counts for n in (10, 20, 29)) and ("k1", day(3)) not in counts and counts["k2", day(3)] == 1
    assert {r.row_id for r in R.orphan_references(made, there).collect()} == plain(refs, targets)


def test_spans_of_many_arrivals_and_withdrawals(spark):
    """A key whose existence rises and falls across blocks of time."""
    targets = [("p", "k", day(a), day(b)) for a, b in [(0, 10), (5, 20), (20, 30), (40, 90), (41, 41), (50, 45), (200, 201)]]
    refs = [(n, "p", "k", day(n)) for n in range(0, 210)]
    made, there = frames(spark, refs, targets)
    assert {r.row_id for r in R.orphan_references(made, there).collect()} == plain(refs, targets)
    spans = R.existence_spans(R.deltas(R.split_settled(there), "exists")).orderBy("since").collect()
    assert [(s.since, s.until) for s in spans] == [(day(0), day(30)), (day(40), day(90)), (day(200), day(201))]


def test_counts_kept_from_deltas(spark):
    made, there = frames(spark, [(1, "p", "a", day(1)), (2, "p", "a", day(2)), (3, "p", "b", day(2))], [("p", "a", day(0), None)])
    state = R.apply_deltas(None, R.deltas(made, "refs"))
    assert {(r.key, r.refs) for r in R.orphan_keys(state).collect()} == {("a", 2), ("b", 1)}
    state = R.apply_deltas(state, R.deltas(there, "exists"))
    assert {(r.key, r.refs) for r in R.orphan_keys(state).collect()} == {("b", 1)}
    gone = spark.createDataFrame([("x", "p", "a", -1), ("x", "p", "b", 1)], "target string, provider string, key string, exists int")
    state = R.apply_deltas(state, gone)
    assert {(r.key, r.refs) for r in R.orphan_keys(state).collect()} == {("a", 2)}


def test_empty_tables_and_periods(spark):
    made, there = frames(spark, [], [])
    assert R.orphan_references(made, there).count() == 0
    made, _ = frames(spark, [(1, "p", "a", day(1)), (2, "p", "a", day(40)), (3, "p", "z", None)], [])
    got = {(r.period, r.orphans, r["keys"]) for r in R.orphans_by_period(R.orphan_references(made, there)).collect()}
    assert got == {(datetime(2024, 1, 1), 1, 1), (datetime(2024, 2, 1), 1, 1), (None, 1, 1)}
