import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marginalia.session import build_session  # noqa: E402

DATA = os.environ.get("MARGINALIA_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("marginalia-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-checkpoint-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="run-warehouse-")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate one column expression over a list of strings (column ``x``)."""
    def run(expression, *values):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        rows = frame.select("i", expression.alias("y")).orderBy("i").collect()
        return [r.y for r in rows]
    return run
