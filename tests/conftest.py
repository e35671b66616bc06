import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from spliceforge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, **{"spark.driver.memory": "3g", "spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples, nulls first."""

    def of(df):
        key = lambda r: tuple((v is not None, str(type(v)), v if not isinstance(v, (list, dict)) else str(v)) for v in r)
        return sorted((tuple(r) for r in df.collect()), key=key)

    return of
