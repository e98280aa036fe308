import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("FLOWLENS_DRIVER_MEMORY", "6g")
    from flowlens.session import ensure_checkpoint_dir, get_spark

    s = get_spark("flowlens-tests", master="local[4]", shuffle_partitions=4)
    ensure_checkpoint_dir(s)
    yield s
