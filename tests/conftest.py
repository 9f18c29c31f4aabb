import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from matchlake.session import build_session

    session = build_session("local[*]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not SF.exists():
        pytest.skip("no test tables here")
    return str(SF)
