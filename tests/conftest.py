import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cataloom.session import get_spark
    wh = tmp_path_factory.mktemp("warehouse")
    s = get_spark("local[4]", app="cataloom-tests", shuffle_partitions=8,
                  extra={"spark.sql.warehouse.dir": str(wh)})
    yield s
    s.stop()
