import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

SMALL = os.environ.get("SEQUORA_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sequora.session import session

    work = tmp_path_factory.mktemp("spark")
    return session(4, {"spark.checkpoint.dir": str(work / "shared"), "spark.sql.warehouse.dir": str(work / "warehouse"), "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL
