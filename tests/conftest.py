import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quernstone.session import session

    s = session("tests", int(os.environ.get("TEST_CPUS", "4")))
    yield s
    s.stop()
