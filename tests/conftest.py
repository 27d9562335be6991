"""One session for all tests.  Tables are those of the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from cairn.session import session

    s = session(4, "tests", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    return at


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con
