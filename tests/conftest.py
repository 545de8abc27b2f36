import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


# Python workers find the package and the test modules through the environment they inherit.
os.environ["PYTHONPATH"] = os.pathsep.join([*sys.path[:2], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from catalogloom.session import local_session

    session = local_session(4, app="tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
