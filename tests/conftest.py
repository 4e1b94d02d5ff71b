import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from codestrata import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build(master="local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def make_files(spark):
    def make(*rows, project="p"):
        full = [(project, *r) if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, "project string, path string, content string")
    return make
