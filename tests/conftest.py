import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from oracle.compare import local_session  # noqa: E402
from rollcall.sources.store import load, publish  # noqa: E402
from tests.seed import seed_model  # noqa: E402

SF = "/root/testdata/sf0.001"
AS_OF = "2026-06-01 09:00:00"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seed(spark, tmp_path_factory):
    """The fixture, loaded into a fresh snapshot and read back."""
    root = str(tmp_path_factory.mktemp("seed"))
    publish(seed_model(spark), root, 1)
    return load(spark, root)


@pytest.fixture(scope="session")
def prepared(seed):
    from rollcall.plans.refresh import prepare

    return prepare(seed, AS_OF)
