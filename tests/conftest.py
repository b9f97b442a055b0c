import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

TESTDATA = Path(os.environ.get("TESSITURA_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from tessitura.session import session

    settings = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    found = session("tests", "local[4]", **settings)
    found.sparkContext.setLogLevel("OFF")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = TESTDATA / "sf0.001"
    if not path.is_dir():
        pytest.skip("no test tables here")
    return str(path)
