from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from cinderlog.schemas import LOGS  # noqa: E402
from cinderlog.session import local_session  # noqa: E402
from cinderlog.sources.tables import LogStore  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables")
    return SF_DIR


def log_row(number: int, when: datetime, level="info", service="auth", message="hello", attributes=None):
    return (number, when, level, service, message, attributes)


@pytest.fixture(scope="session")
def sample(spark):
    """Five days of rows, three per instant, one service with a third of them all."""
    start = datetime(2024, 3, 1)
    levels, services = ("debug", "info", "warn", "error"), ("hot", "auth", "hot", "billing", "cart", "mail")
    rows = [
        log_row(
            i, start + timedelta(seconds=997 * (i // 3)), levels[i % 4], services[i % 6],
            f"Request {i % 17} took_{i % 5} at 100%", {"k": str(i % 7), "a.b": "x"} if i % 3 else None,
        )
        for i in range(1300)
    ]
    return rows


@pytest.fixture(scope="session")
def sample_df(spark, sample):
    return spark.createDataFrame(sample, LOGS)


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"))


@pytest.fixture(scope="session")
def stored(spark, sample_df, tmp_path_factory):
    store = LogStore(spark, str(tmp_path_factory.mktemp("stored")))
    store.append_logs(sample_df.where("id % 2 = 0"), 0)
    store.append_logs(sample_df.where("id % 2 = 1"), 1)
    return store
