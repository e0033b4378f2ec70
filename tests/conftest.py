import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from kinfold.runtime import session

    s = session("local[4]", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def data(name: str = "sf0.01") -> str:
    return f"/root/testdata/{name}"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(data("sf0.001")):
        pytest.skip("test tables are not here")
    return data("sf0.001")
