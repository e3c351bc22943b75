import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidewatch.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4")
    s.sparkContext.setLogLevel("ERROR")
    return ship(s)
