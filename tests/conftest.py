import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark():
    from meshloom.session import local_session

    session = local_session(4, "4g")
    yield session
    session.stop()
