import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from veriloom.plans.session import build_session

    return build_session(cpus=4, partitions=4, **{"spark.driver.memory": "4g"})
