import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from weftline.session import session

    out = session("tests", "local[4]", 2, spark__ui__enabled="false", spark__driver__memory="4g")
    out.sparkContext.setLogLevel("ERROR")
    return out
