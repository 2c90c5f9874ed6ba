import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from bizlens.session import build_session

    session = build_session("tests", "8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows and DDL to a DataFrame."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


def rows(df, *cols):
    """Rows as sorted tuples, of the given columns or all."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
