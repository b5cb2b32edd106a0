import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from verdikt.session import build_session
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as a dict by key columns."""
    def collect(df, *keys):
        return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict(recursive=True) for r in df.collect()}
    return collect
