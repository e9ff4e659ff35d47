import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pagetrove.session import local_session

    return local_session(8, shuffle_partitions=4, memory="6g")


@pytest.fixture
def sf_small():
    return SF_SMALL
