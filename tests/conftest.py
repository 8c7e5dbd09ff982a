import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from deltaboard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="deltaboard-tests-")
    session = local_session(
        4, "6g", **{"spark.python.sql.dataFrameDebugging.enabled": "false", "spark.checkpoint.dir": folder}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
