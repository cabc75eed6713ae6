import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    s = local_session("8", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
