import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from braidframe.session import drop_cuts, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4, **{"spark.driver.memory": "6g", "spark.sql.autoBroadcastJoinThreshold": "256k"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_leftovers(request):
    """Intermediate tables of a test go with it."""
    yield
    if "spark" in request.fixturenames:
        drop_cuts(request.getfixturevalue("spark"))
