from __future__ import annotations

import tempfile

import pytest

from quernlake.session import build


@pytest.fixture(scope="session")
def spark():
    root = tempfile.mkdtemp(prefix="quernlake-test-")
    s = build("local[8]", 8, **{"spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": f"{root}/warehouse", "spark.checkpoint.dir": f"file://{root}/shared"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
