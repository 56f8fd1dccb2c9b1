import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, **{"spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
