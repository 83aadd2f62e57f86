import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from glyphlake.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        "tests", cores=4, extra={"spark.checkpoint.dir": str(shared), "spark.sql.shuffle.partitions": "8"}
    )
    yield session
    session.stop()
