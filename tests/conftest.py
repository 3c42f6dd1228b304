import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers import the test modules too
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE])

from keysift.session import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def units(spark):
    """Builds units from texts or (text, line_nos) pairs."""
    from keysift import schemas

    def build(*texts, repository="r", commit_hash="uncommitted"):
        rows = []
        for i, t in enumerate(texts):
            text, line_nos = t if isinstance(t, tuple) else (t, None)
            rows.append((repository, commit_hash, 0, "untracked", f"f{i}", None, None, text, line_nos))
        return spark.createDataFrame(rows, schemas.UNITS)

    return build
