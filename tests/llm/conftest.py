from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    return make
