import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelflow.session import STATE_STORE_CONF, tune


@pytest.fixture(scope="session")
def spark():
    builder = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g"))
    for key, value in STATE_STORE_CONF.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()
