import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from panelrisk.session import local_session

    s = local_session("*", shuffle_partitions=8, app="panelrisk-tests")
    yield s


@pytest.fixture(autouse=True, scope="module")
def own_cache():
    """Tables that a module's tests cache do not show up in the plans of the next module."""
    from pyspark.sql import SparkSession

    yield
    if (s := SparkSession.getActiveSession()) is not None:
        s.catalog.clearCache()
