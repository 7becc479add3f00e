import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kgprep import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", shuffle_partitions=4,
                extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="kgprep-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
