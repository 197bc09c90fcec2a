import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from statuta.session import get_spark

    session = get_spark(app="tests", cores="4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "2g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
