import os
import sys, os
sys.path.insert(0, os.path.dirname(__file__))
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from freightline.session import get_session
    ckpt = tempfile.mkdtemp(prefix="fl-test-ckpt-")
    s = get_session(master="local[4]", shuffle_partitions=4, extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.exists(SF_SMALL):
        pytest.skip("test data not present")
    return SF_SMALL
