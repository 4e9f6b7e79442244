import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = os.environ.get("LOREKIT_TEST_SF", "/root/testdata/sf0.001")
SF_ORACLE = os.environ.get("LOREKIT_ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lorekit.session import get_spark
    s = get_spark("lorekit-tests", shuffle_partitions=8)
    yield s


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
