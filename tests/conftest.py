import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from apotheca.session import session

    # A plan too large to be compiled is an error in tests, not a slower run.
    settings = {"spark.sql.codegen.fallback": "false", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    found = session("tests", "local[4]", **settings)
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
