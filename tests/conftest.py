"""One local session for all tests, and the driver's tables in DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from strandline.session import local_session, ship

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session(4, memory="4g", app="tests"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con
