from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from textloom.session import local_session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    s = local_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
