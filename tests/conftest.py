import pytest

from folioforge.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "4g", "spark__checkpoint__dir": f"file://{tmp_path_factory.mktemp('checkpoint')}"}
    session = get_spark(master="local[4]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    return session
