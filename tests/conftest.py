import pytest

from lumenarc.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.files.maxPartitionBytes": "16m"})
