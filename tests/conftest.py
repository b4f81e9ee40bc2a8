import tempfile

import pytest

from wirefold import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "wirefold-tests", master="local[4]", shuffle_partitions=4,
        **{"spark.driver.memory": "4g",
           "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="wirefold-wh-")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
