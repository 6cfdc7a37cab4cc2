from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import build_session

    session = build_session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="3g", spark_ui_enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
