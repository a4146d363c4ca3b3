import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablescour.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4,
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Canonical frame from ``{column: values}`` with row labels 0, 1, 2, …"""

    def build(**columns):
        names = list(columns)
        rows = [(i, *values) for i, values in enumerate(zip(*columns.values()))]
        schema = "_row bigint, " + ", ".join(f"`{n}` string" for n in names)
        return spark.createDataFrame(rows, schema)

    return build
