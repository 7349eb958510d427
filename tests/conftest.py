import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from shotweave.session import build_session

    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
                      spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tiny_chunks(monkeypatch):
    """Chunks of three units, so that carries between chunks are exercised on small data."""
    from shotweave.operators import detect, ordered

    monkeypatch.setattr(ordered, "CHUNK", 3)
    monkeypatch.setattr(detect, "CHUNK", 3)
