import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from caseloom.session import local_session
    ck = tempfile.mkdtemp(prefix="caseloom-test-ck-", dir="/tmp")
    s = local_session(app="caseloom-tests", cores="*", shuffle_partitions=8, checkpoint_dir=ck)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="caseloom-test-", dir="/tmp")


@pytest.fixture(params=["window", "range"])
def numbering_path(request, monkeypatch):
    """Run a test with small groups numbered by a window, and again with
    the range-partitioned form forced (bound 0)."""
    import caseloom.plans.numbering as numbering
    if request.param == "range":
        monkeypatch.setattr(numbering, "WINDOW_GROUP_ROWS", 0)
    return request.param
