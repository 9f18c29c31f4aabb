import random
from datetime import datetime

from pyspark.sql import functions as F

from matchlake.operators import deliveries
from matchlake.plans import problems
from matchlake.session import table

SCHEMA = "delivery_id bigint, provider string, record_type string, provider_record_id string, source_batch_id string, fetched_at timestamp"


def plain(rows):
    """Ids of the rows to drop, by a dictionary."""
    first = {}
    last = datetime.max
    for r in rows:
        if r[3] is None or not r[3].strip():
            continue
        key = (r[1], r[2], r[3].strip().lower())
        order = (r[5] or last, r[5] is None, r[4] is None, r[4] or "", r[0])
        first[key] = min(first.get(key, order), order)
    keep = {o[-1] for o in first.values()}
    return {r[0] for r in rows if r[0] not in keep and r[3] is not None and r[3].strip()}


def test_against_a_dictionary(spark):
    rng = random.Random(7)
    t = lambda: rng.choice([None, *[datetime(2024, 1, d) for d in (1, 2, 3)]])
    ids = ["a", "A ", "b", " B", "c", "", "  ", None, "x" * 300, "X" * 300 + " ", "x" * 299 + "y", "ab", "a:b", "é", "É"]
    rows = [(i, rng.choice(["p", "q", None]), rng.choice(["match", "odds"]), rng.choice(ids + ["hot"] * 15), rng.choice([None, "b1", "b2"]), t()) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("__Quotient", F.lit("clash"))
    assert {r[0] for r in deliveries.dropped_deliveries(df).collect()} == plain(rows)
    kept = deliveries.deduplicated(df)
    assert kept.columns == df.columns and {r.delivery_id for r in kept.collect()} == {r[0] for r in rows} - plain(rows)


def test_hash_aggregation_and_one_message_on_a_third_of_the_rows(spark):
    """No sort before the table, and the first of the copies comes out though many arrive at one instant."""
    at = lambda n: datetime(2024, 1, 1, 0, 0, n % 60)
    rows = [(i, "p", "match", "hot", f"b{(i * 7) % 13:02d}", at(7)) for i in range(300)] + [(1000 + i, "p", "match", f"m{i // 2}", "b", at(i)) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    named, names = deliveries.with_quotient(df, [F.col("provider"), F.col("provider_record_id")])
    plan = named.groupBy(*names).agg(F.min(deliveries._number(F.unix_micros("fetched_at"), F.col("delivery_id"))).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert {r[0] for r in deliveries.dropped_deliveries(df).collect()} == plain(rows)


def test_order_in_one_number(spark):
    """Arrival, then row id; unknown and impossible arrivals last and first; the id comes back out of the number."""
    rows = [(t, i) for t in (None, -(10**18), -62135596800000000, -1, 0, 1, 253402300799999999, 10**18) for i in (-(2**63), -1, 0, 5, 2**63 - 1)]
    df = spark.createDataFrame(rows, "t bigint, i bigint").select("t", "i", deliveries._number(F.col("t"), F.col("i")).alias("n"), deliveries._number(F.col("t"), F.col("i"), True).alias("d"))
    got = df.select("t", "i", "n", deliveries._row_of(F.col("n")).alias("a"), deliveries._row_of(F.col("d"), True).alias("b")).collect()
    assert all(r.a == r.b == r.i for r in got)
    limit = lambda t: 10**18 if t is None else min(max(t, -62135596800000000), 10**18 - 2 - 62135596800000000)
    assert [(r.t, r.i) for r in sorted(got, key=lambda r: (r.n, str(r.t)))] == [(r.t, r.i) for r in sorted(got, key=lambda r: (limit(r.t), r.i, str(r.t)))]


def test_permutation_spreads_the_quotient(spark):
    """Identifiers that differ only in their first or only in their last bytes fill the quotients evenly."""
    rows = [(f"{i:05d}same", f"same{i:05d}") for i in range(4096)]
    df = spark.createDataFrame(rows, "a string, b string")
    for c in "ab":
        named, _ = deliveries.with_quotient(df, [F.col(c)], 4)
        counts = [r["count"] for r in named.groupBy("__quotient").count().collect()]
        assert len(counts) == 16 and max(counts) < 2 * 256


def test_repeated_equal_rows_and_empty_table(spark):
    rows = [(1, "p", "match", "a", "b", datetime(2024, 1, 1))] * 3
    assert deliveries.dropped_deliveries(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert deliveries.deduplicated(spark.createDataFrame(rows, SCHEMA)).count() == 1
    assert deliveries.dropped_deliveries(spark.createDataFrame([], SCHEMA)).count() == 0


def test_permutation_has_no_false_matches(spark):
    """Identifiers that differ in one bit or in where their parts end get different quotient or remainder."""
    rows = [(chr(97 + a), chr(97 + b) * n) for a in range(16) for b in range(16) for n in (1, 2, 60)] + [("a", ":1:b"), ("a:1", ":b"), ("", "ab"), ("ab", ""), (None, "ab"), ("-", "ab")]
    named, names = deliveries.with_quotient(spark.createDataFrame(rows, "a string, b string"), [F.col("a"), F.col("b")])
    assert named.select(*names).distinct().count() == len(set(rows))


def test_all_messages_once(spark, sf):
    raw = table(spark, sf, "raw_record")
    dropped = problems.p1_found(spark, sf).count()
    messages = raw.select("provider", "record_type", F.lower(F.trim("provider_record_id"))).distinct().count()
    assert dropped == raw.count() - messages > 0
