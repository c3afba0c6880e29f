import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rillflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "rillflow-tests", "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.conf.set("spark.sql.maxMetadataStringLength", "1000")
    yield session
    session.stop()


@pytest.fixture
def shared(spark, tmp_path):
    """A scratch folder as a URL."""
    return "file://" + str(tmp_path)
