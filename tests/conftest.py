import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from almacen.session import build_session
    s = build_session(master="local[*]", app="almacen-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def star(spark):
    from almacen.plans import warehouse
    return warehouse.star(spark, SF_SMALL)


@pytest.fixture(scope="session")
def scratch(spark):
    from almacen.session import scratch_path
    return lambda name: scratch_path(spark, name)
