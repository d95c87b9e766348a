import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sift.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[2]", 4, app_name="sift-tests")
    yield s
    s.stop()


@pytest.fixture
def short_batches(spark):
    """Python tasks get their rows in batches of four, as tasks over 10,000 rows get them in several."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    yield
    spark.conf.set(key, before)
