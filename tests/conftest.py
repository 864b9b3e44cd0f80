import pytest

from gradeflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, **{"spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
