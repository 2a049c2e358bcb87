import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__  # noqa: E402,F401
from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("8")
