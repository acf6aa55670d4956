import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from coppice.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def planted(spark):
    """y = 3a + b + noise; c is not used; d is a category with its own effect."""
    from pyspark.sql import functions as F

    return (
        spark.range(3000, numPartitions=4)
        .withColumn("a", F.rand(1) * 10)
        .withColumn("b", F.rand(2) * 10)
        .withColumn("c", F.rand(3) * 10)
        .withColumn("d", F.concat(F.lit("level"), (F.col("id") % 3).cast("string")))
        .withColumn("y", 3 * F.col("a") + F.col("b") + F.col("id") % 3 + F.randn(4))
    )
