import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from glossa.session import build_session
    s = build_session("local[8]", app="glossa-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="glossa-test-ckpt-")})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
