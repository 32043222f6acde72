import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from inodeatlas.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__sql__shuffle__partitions="2",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
