import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from tillwise import build_session
    warehouse = tempfile.mkdtemp(prefix="tillwise-warehouse-", dir="/tmp")
    s = build_session("local[4]", app_name="tillwise-tests", shuffle_partitions=8,
                      extra={"spark.sql.warehouse.dir": warehouse})
    yield s


@pytest.fixture(scope="session")
def tables_small(spark):
    from tillwise.sources import Tables
    return Tables.from_dir(spark, SF_SMALL)


@pytest.fixture(scope="session")
def duck_small():
    from tests.oracle_compare import duck
    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def duck_mid():
    from tests.oracle_compare import duck
    return duck(SF_MID)
