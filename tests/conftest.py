import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from txrisk.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="txrisk-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="txrisk-test-ckpt-"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="txrisk-test-")
