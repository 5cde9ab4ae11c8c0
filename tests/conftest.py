import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from crewmetrics.session import RECOMMENDED_CONF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sample(spark, tmp_path_factory):
    """The sample rows as typed tables, unmasked."""
    from crewmetrics import schemas
    from crewmetrics.sources.files import read_csv
    from tests.sample import FILES, write

    folder = write(tmp_path_factory.mktemp("sample"))
    return {t: read_csv(spark, f"{folder}/{t}.csv", schemas.TABLES[t], ordinal=True).cache() for t in FILES}
