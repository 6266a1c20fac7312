import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session

    session = local_session(4, shuffle_partitions=2, app="tests")
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a small DataFrame from rows and a schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
