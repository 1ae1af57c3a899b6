import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from strandwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, 8, "8g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session


@pytest.fixture
def seqs(spark):
    def make(*rows):
        data = [r if isinstance(r, tuple) else (f"s{i}", r) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "seq_id STRING, seq STRING")

    return make


@pytest.fixture
def motif_table(spark):
    return lambda *names: spark.createDataFrame([(m,) for m in names], "motif STRING")
