import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ravelin.session import session

    scratch = tmp_path_factory.mktemp("spark")
    s = session(
        "tests",
        "local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__local__dir=str(scratch / "local"),
        spark__checkpoint__dir=f"file://{scratch}/shared",
        spark__sql__warehouse__dir=str(scratch / "warehouse"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
