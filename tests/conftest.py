import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from cinderloom.session import get_session

    session = get_session("tests", 8)
    yield session
    session.stop()
