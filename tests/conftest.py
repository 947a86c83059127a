import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from stratalog.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bronze(spark):
    from stratalog.sources.derived import bronze_catalogue

    return bronze_catalogue(spark, SF_DIR).persist()


@pytest.fixture(scope="session")
def silver(bronze):
    from stratalog.config import SilverRules
    from stratalog.plans.silver import silver as build

    return build(bronze, SilverRules(processed_at="2026-02-09 12:00:00")).persist()
