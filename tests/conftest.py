from __future__ import annotations

import pytest

from corpusward.session import build_session
from corpusward.streaming import threads


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over a single row."""

    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return value


@pytest.fixture()
def stateful(spark):
    """The session with streams' state on disk."""
    for name, value in threads.STATE_SETTINGS.items():
        spark.conf.set(name, value)
    yield spark
    for name in threads.STATE_SETTINGS:
        spark.conf.unset(name)
