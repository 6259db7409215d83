import pytest

from mediaframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4, partitions=4, driver_memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
