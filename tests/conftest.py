from __future__ import annotations

import pytest

from curalith.session import build_session, ensure_checkpoint_dir


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for tables too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture
def stored(tmp_path):
    """A frame read back from Parquet, whose size Spark knows, as opposed to a Python list's."""

    def store(df):
        path = str(tmp_path / f"stored-{len(list(tmp_path.iterdir()))}")
        df.coalesce(1).write.parquet(path)
        return df.sparkSession.read.parquet(path)

    return store


def rows(df):
    """Rows as a sorted list of tuples; sorting by text lets nulls in."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
