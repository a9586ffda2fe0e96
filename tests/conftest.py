import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from trackdensity.session import session

    s = session(os.environ.get("TEST_MASTER", "local[4]"), 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
