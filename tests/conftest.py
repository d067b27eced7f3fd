from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mercato.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    # catalog tables of the tests go to a fresh scratch folder, not the working dir
    warehouse = tempfile.mkdtemp(prefix="run-warehouse-", dir="/tmp")
    session = build_session(
        "local[*]", 8, app_name="mercato-tests", extra={"spark.sql.warehouse.dir": warehouse}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def micro(spark):
    from micro_fixture import micro_tables

    return micro_tables(spark)
