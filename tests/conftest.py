import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from photolake.session import get_session, use_package

    s = get_session("tests", 8, 4)
    s.sparkContext.setLogLevel("ERROR")
    use_package(s)
    return s
