from pyspark.sql import functions as F

from matchlake.plans import imports
from matchlake.session import table


def test_schedules_are_compared_as_instants(spark, sf, tmp_path):
    feed = table(spark, sf, "provider_feed")
    feed.write.parquet(str(tmp_path / "provider_feed.parquet"))
    times = [(1, "same", "2024-01-01T10:00:00Z"), (2, "same", "2024-01-01T12:00:00+02:00"), (3, "moved", "2024-01-01T12:00:00+02:00"), (4, "moved", "2024-01-01T13:00:00+02:00")]
    rows = spark.createDataFrame([(i, (feed.head().provider, k), t) for i, k, t in times], "match_row_id bigint, provenance struct<provider:string,provider_record_id:string>, scheduled_at string")
    rows = rows.withColumn("provenance", F.col("provenance").withField("ingested_at", F.timestamp_seconds("match_row_id")))
    empty = {"completed_at": "string", "actual_start_at": "timestamp", "winner_external_id": "string", "status": "string", "sets": "array<struct<set_number:int,player_a_points:int,player_b_points:int>>"}
    rows.withColumns({c: F.lit(None).cast(kind) for c, kind in empty.items()}).withColumn("status", F.lit("finished")).write.parquet(str(tmp_path / "imported_match.parquet"))
    out = {r.match_row_id: (r.outcome, r.reason) for r in imports.dedupe_matches(spark, str(tmp_path)).collect()}
    assert out == {1: ("inserted", None), 2: ("skipped_idempotent", None), 3: ("inserted", None), 4: ("rejected_conflict", "scheduled_at")}
