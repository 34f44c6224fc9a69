import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from calibrel.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(8, "tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
