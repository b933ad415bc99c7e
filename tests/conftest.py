import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from tillroll.session import local_session, use_shared_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, shuffle_partitions=4, app="tests")
    use_shared_folder(session, str(tmp_path_factory.mktemp("stages")))
    return session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
