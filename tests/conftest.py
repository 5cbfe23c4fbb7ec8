"""One session for all tests, and the repository on the path of driver and workers."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from brindle.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    found.sparkContext.setLogLevel("ERROR")
    return found
