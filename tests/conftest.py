import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
