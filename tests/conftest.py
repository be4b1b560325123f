import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from basketry.session import get_spark
    yield get_spark("local[*]", shuffle_partitions=8, **{
        "spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="basketry-test-ckpt-")})


SF_SMALL = "/root/testdata/sf0.001"
