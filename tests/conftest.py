import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TYPEGRAM_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from typegram.session import local_session

    return local_session(4, partitions=4)
