import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern.session import local_session, ship

    s = local_session(4, 4)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    ship(s)
    yield s
    s.stop()
