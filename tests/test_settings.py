import json
import logging

import pytest
from pyspark.sql import functions as F

from matchlake import settings
from matchlake.functions import columns


def test_settings_are_checked():
    settings.FeatureSettings()
    settings.ImportSettings(warnings="reject")
    for wrong in ({"windows": (5, 5)}, {"windows": ()}, {"windows": (0, 3)}, {"windows": (10, 5)}, {"train": 0.7}, {"train": -0.2, "validation": 1.0}, {"schema_version": "1.0"}, {"builder_version": "v1.0.0"}, {"half_life_days": 0}):
        with pytest.raises(ValueError):
            settings.FeatureSettings(**wrong)
    for wrong in ({"checkpoint_version": "1"}, {"warnings": "drop"}, {"batch_size": 0}, {"window_seconds": -1}):
        with pytest.raises(ValueError):
            settings.ImportSettings(**wrong)
    assert settings.increasing((0.35, 0.6, 0.8)) and settings.weights({"a": 0.5, "b": 0.5})
    with pytest.raises(ValueError):
        settings.increasing((1, 1))


def test_log_lines_are_json():
    record = logging.LogRecord("x", logging.WARNING, "f", 1, "read %d", (3,), None)
    line = json.loads(settings.JsonLog().format(record))
    assert line["message"] == "read 3" and line["level"] == "WARNING" and line["logger"] == "x" and line["timestamp"].endswith("+00:00")


def test_shared_expressions(spark):
    df = spark.createDataFrame([(2.675, "1.2.3"), (0.5, "1.2"), (-0.0000005, "a1.2.3"), (None, None), (float("inf"), "1.2.3\n")], "x double, v string")
    rows = df.select(columns.binary_round(F.col("x"), 2).alias("r"), columns.is_semver(F.col("v")).alias("s")).collect()
    assert [r.r for r in rows] == [2.67, 0.5, -0.0, None, float("inf")] and [r.s for r in rows][:4] == [True, False, False, False]
    z = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,)], "z double").select(columns.sigmoid(F.col("z")).alias("p")).collect()
    assert [r.p for r in z] == [0.0, 0.5, 1.0]
    t = spark.sql("select timestamp'2024-01-02 03:04:05+00:00' a, timestamp'2024-01-02 03:04:05.000600+00:00' b").select(columns.iso_text(F.col("a")).alias("a"), columns.iso_text(F.col("b")).alias("b"), columns.run_id(F.lit("s"), F.lit("p"), F.col("a")).alias("r")).head()
    import hashlib

    assert t.a == "2024-01-02T03:04:05+00:00" and t.b == "2024-01-02T03:04:05.000600+00:00" and t.r == hashlib.sha256(f"s|p|{t.a}".encode()).hexdigest()[:16]
    n = spark.createDataFrame([("Zoë  O'Brien-Łukasz",), (" ",)], "n string").select(columns.normalised_name("n").alias("n"), columns.similarity(F.lit("anna berg"), F.lit("ana berg")).alias("s")).collect()
    assert n[0].n == "zoe o brien łukasz" and n[1].n is None and abs(n[0].s - 16 / 17) < 1e-12
