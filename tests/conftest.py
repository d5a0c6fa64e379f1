import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from songsieve.session import local_session

    session = local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()
