from datetime import datetime, timedelta

from matchlake.sources.store import KeyedTable
from matchlake.streaming import imports

T0 = datetime(2024, 1, 1)
SCHEMA = "message string, delivery_id bigint, payload string"


def put(spark, folder, name, rows):
    raw = [(i, "p", k, "match", "{}", "b", None, T0 + timedelta(hours=i)) for i, k in rows]
    spark.createDataFrame(raw, imports.RAW).coalesce(1).write.mode("append").parquet(str(folder))


def test_import_resumes_and_stores_each_message_once(spark, tmp_path):
    folder, target = tmp_path / "raw", KeyedTable(spark, str(tmp_path / "t"), "message", SCHEMA)
    put(spark, folder, "a", [(1, "x"), (2, "X "), (3, "y")])
    put(spark, folder, "b", [(4, "y"), (5, "z")])
    run = lambda: imports.import_once(spark, str(folder), target, str(tmp_path / "c"))
    first = run()
    assert sum(r["read"] for r in first) == 5 and sum(r["stored"] for r in first) == 3 and len(first) == 2
    assert run() == [] and target.count() == 3
    put(spark, folder, "c", [(6, "z"), (7, "w")])
    assert [(r["read"], r["stored"]) for r in run()] == [(2, 1)]
    batch = KeyedTable(spark, str(tmp_path / "t2"), "message", SCHEMA)
    imports.import_once(spark, str(folder), batch, str(tmp_path / "c2"), files_per_batch=100)
    assert {r.message for r in batch.read().collect()} == {r.message for r in target.read().collect()}


def test_stream_without_repeats(spark, tmp_path):
    put(spark, tmp_path / "raw", "a", [(1, "x"), (2, "X"), (3, "y"), (4, None)])
    stream = imports.distinct_messages(imports.raw_stream(spark, str(tmp_path / "raw")))
    query = imports.to_memory(stream, "once")
    query.awaitTermination()
    assert {(r.provider_record_id or "").lower() for r in spark.table("once").collect()} == {"x", "y", ""}


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=7 * i), f"t{i % 2}", i % 3, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, user_id long, value double")
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    query = imports.to_memory(imports.event_windows(stream), "w", "complete")
    query.awaitTermination()
    want = {tuple(r) for r in imports.event_windows(df).collect()}
    assert {tuple(r) for r in spark.table("w").collect()} == want and sum(r[3] for r in want) == 60
    assert imports.event_sessions(df, "10 minutes").count() > 1


def test_messages_without_an_identifier_are_messages_of_their_own(spark, tmp_path):
    from datetime import datetime

    rows = [(i, "p", rid, "match", "{}", "b", None, datetime(2024, 1, 1, 0, i)) for i, rid in enumerate((None, "", "  ", "a", "A ", "b"))]
    raw = spark.createDataFrame(rows, imports.RAW)
    assert imports.message_key(raw).select("message").distinct().count() == 5
    raw.write.parquet(str(tmp_path / "raw"))
    query = imports.to_memory(imports.distinct_messages(imports.raw_stream(spark, str(tmp_path / "raw"))), "blank_ids")
    query.awaitTermination()
    got = {r.delivery_id for r in spark.table("blank_ids").collect()}
    assert got >= {0, 1, 2, 5} and len(got) == 5
    target = KeyedTable(spark, str(tmp_path / "t"), "message", SCHEMA)
    reports = imports.import_once(spark, str(tmp_path / "raw"), target, str(tmp_path / "cp"), lambda df: df.select(*target.read().columns))
    assert sum(r["stored"] for r in reports) == target.count() == 5
