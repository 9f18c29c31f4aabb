from pyspark.sql import functions as F

from matchlake.plans import imports, problems


def test_readable_times_are_not_missing(spark, sf):
    found = problems.p3_found(spark, sf)
    ids = lambda df, c: {r[0] for r in df.select(c).collect()}
    for rows, key, field in ((imports.validate_matches(spark, sf), "match_row_id", "scheduled_at"), (imports.validate_odds(spark, sf), "odds_row_id", "captured_at")):
        readable = ids(found.where(F.col("field_name") == field), "row_id")
        assert readable and not readable & ids(rows.where(F.col("code") == f"missing_{field}"), key)
