import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quaycheck.session import local_session, shared_folder

    s = local_session(8, "quaycheck-tests")
    shared_folder(s)
    yield s
    s.stop()
