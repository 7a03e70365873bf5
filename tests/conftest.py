import pytest

from sheafline.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 8)
    s.conf.set("spark.sql.shuffle.partitions", "3")  # tables are small
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
