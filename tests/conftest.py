"""One Spark session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from isobar.session import local_session

    out = local_session(cores=4, partitions=4, warehouse=str(tmp_path_factory.mktemp("warehouse")))
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF
