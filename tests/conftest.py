import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from holdfast.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = get_session(
        "holdfast-tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.checkpoint.dir": shared},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def cohort(spark):
    """200 rows, 60 positive, two features and two attributes."""
    rows = [
        (i, i // 2, int(i % 10 < 3), float(i % 17) + 3.0 * (i % 10 < 3), float(i % 5), "ab"[i % 2], "xyz"[i % 3])
        for i in range(200)
    ]
    return spark.createDataFrame(
        rows, "id bigint, entity_id bigint, y int, f1 double, f2 double, g string, h string"
    ).cache()
