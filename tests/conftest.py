import pytest

from millrace.session import build


@pytest.fixture(scope="session")
def spark():
    s = build("millrace-tests", cores=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
