import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from compare import spark_session
    s = spark_session()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
