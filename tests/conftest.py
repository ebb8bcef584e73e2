import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from groundloom.session import session

    shared = tmp_path_factory.mktemp("checkpoints")
    s = session("local[4]", **{"spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(shared))
    yield s
    s.stop()
