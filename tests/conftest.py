import pytest

from lodeflow.session import build_session, cleanup


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    cleanup(session)
    session.stop()
