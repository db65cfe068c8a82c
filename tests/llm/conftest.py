import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

from llm_rows import TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as E
    from eventimpact.llm.common import bounded_batches
    from eventimpact.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="eventimpact-llm-tests", shuffle_partitions=4)
    checkpoint_dir(s)
    bounded_batches(s)
    E._ship(s)
    yield s


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "src", 7, "clash", 0.5) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, SCORE long, ids string, Offset double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
