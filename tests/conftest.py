import tempfile

import pytest

from quire.runtime import session


@pytest.fixture(scope="session")
def spark():
    made = session(
        "quire-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
