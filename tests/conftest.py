import pytest

from factloom.session import build


@pytest.fixture(scope="session")
def spark():
    s = build("local[4]", 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
