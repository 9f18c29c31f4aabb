from matchlake.plans import behaviour
from matchlake.session import table


def test_words_and_impossible_dates_are_unreadable(spark, sf, tmp_path):
    times = ["2024-02-28T18:00:00Z", "TBD", "-", "2024-02-30 18:00", "2024-02-28 18:00", " "]
    table(spark, sf, "provider_feed").write.parquet(str(tmp_path / "provider_feed.parquet"))
    feed = table(spark, sf, "provider_feed").where("time_zone is not null").head().provider
    rows = [(i, "m", "b", 2.0, t, (feed, "m"), "a", "c", "live", t) for i, t in enumerate(times)]
    made = spark.createDataFrame(rows, "odds_row_id bigint, provider_match_id string, bookmaker string, decimal_odds double, captured_at string, provenance struct<provider:string,provider_record_id:string>, player_a_external_id string, player_b_external_id string, status_raw string, scheduled_at string")
    made.write.parquet(str(tmp_path / "imported_odds.parquet"))
    made.withColumnRenamed("odds_row_id", "match_row_id").write.parquet(str(tmp_path / "imported_match.parquet"))
    bad = {i: "unreadable time" for i in (1, 2, 3, 5)}
    for query, key in ((behaviour.normalize_odds, "odds_row_id"), (behaviour.normalize_matches, "match_row_id")):
        assert {r[key]: r.reason for r in query(spark, str(tmp_path)).collect() if r.reason} == bad
