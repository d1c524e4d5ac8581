from __future__ import annotations

import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    yield make_session(**{"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": warehouse,
                          "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema) -> DataFrame"""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df):
    return [tuple(r) for r in df.collect()]
