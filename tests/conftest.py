import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera import tables  # noqa: E402
from tessera.session import local  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local(4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    tables.ship(session)
    yield session
    session.stop()
