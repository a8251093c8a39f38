from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from fernweave.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    folder = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "fernweave-tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.checkpoint.dir": folder, "spark.sql.maxMetadataStringLength": "10000"}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
