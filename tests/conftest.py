import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from coppice.session import build_session, clear_scratch
    session = build_session("tests", "local[8]", 8, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "10g", "spark.ui.showConsoleProgress": "false"})
    yield session
    clear_scratch(session)
    session.stop()
