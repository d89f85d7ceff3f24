from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stratlas.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, "4g", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=f"file://{shared}/warehouse", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"create view {name[:-8]} as select * from '{data}/{name}'")
    return con
