import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlake.session import ensure_checkpoint_dir, get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", "ledgerlake-tests", shuffle_partitions=8,
                  extra_conf={"spark.driver.memory": "4g"})
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="ledgerlake-test-ckpt-"))
    yield s
    s.stop()
