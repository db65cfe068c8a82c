import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from paths import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from eventimpact.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="eventimpact-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from oracle_check import duck as make
    return make(SF_SMALL)
