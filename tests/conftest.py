import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from flowstream.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[4]", shuffle_partitions=4, app="tests")
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
