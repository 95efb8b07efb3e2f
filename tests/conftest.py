import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from cardloom.runtime import get_spark

    s = get_spark("4", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
