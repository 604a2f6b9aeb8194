import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tickframe.session import local_session

    session = local_session(
        4, "tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not SF.exists():
        pytest.skip("no test tables")
    return str(SF)
