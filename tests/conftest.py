import pytest

from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        spark__sql__shuffle__partitions="2", spark__ui__enabled="false",
        spark__driver__memory="6g", spark__sql__ansi__enabled="true",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
