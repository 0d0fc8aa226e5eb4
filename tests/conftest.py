import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from veil.session import local_session  # noqa: E402
from veil.streaming.streams import ROCKSDB  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, shuffle_partitions=4)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield session
    session.stop()
