from pyspark.sql import functions as F

from matchlake.plans import derived, training


def test_every_match_is_asked_for(spark, sf):
    ids = {r.id for r in derived.matches(spark, sf).select("id").collect()}
    made = [r.match_id for r in training.training_examples(spark, sf).select("match_id").collect()]
    skipped = [r.match_id for r in training.training_skipped(spark, sf).where(F.col("reason") != "not found").collect()]
    assert sorted(made + skipped) == sorted(ids) and any(i % 3 == 0 for i in made)
