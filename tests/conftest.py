import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sparkmend.session import local_session
    s = local_session(4, app="sparkmend-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def write_csv(tmp_path):
    """Write hand-made CSV text to ``<tmp>/<name>.csv`` and return the folder."""
    def _write(name: str, text: str, folder: str = "raw") -> str:
        d = tmp_path / folder
        d.mkdir(exist_ok=True)
        (d / f"{name}.csv").write_text(text)
        return str(d)
    return _write
