import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardline.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "wardline-tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log(spark):
    from wardline.sources.tables import read_log

    return read_log(spark, f"{DATA}/log.csv").cache()


@pytest.fixture(scope="session")
def annotations(spark):
    from wardline.sources.tables import read_annotations

    return read_annotations(spark, f"{DATA}/annotations.jsonl").cache()
