import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from unitloom.session import local_session, ship

    session = ship(local_session(8, 8, "6g"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
