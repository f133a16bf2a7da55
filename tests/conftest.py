import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tables import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from saleslens.session import get_spark

    s = get_spark("local[*]", app_name="saleslens-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fact(spark):
    from saleslens.sources.fixtures import landed_sales_fact

    return landed_sales_fact(spark, SF_SMALL)


@pytest.fixture(scope="session")
def dirty_fact(spark):
    from saleslens.sources.fixtures import landed_sales_fact

    return landed_sales_fact(spark, SF_SMALL, dirty=True)
