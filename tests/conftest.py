import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from samplesmith.session import checkpoint_dir, get_spark
    s = get_spark("samplesmith-tests", master="local[4]", shuffle_partitions=4)
    checkpoint_dir(s, str(tmp_path_factory.mktemp("checkpoints")))
    yield s


SF = "/root/testdata/sf0.001"
