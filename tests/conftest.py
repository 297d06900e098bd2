import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shelfpulse.session import checkpoint_dir, get_session
    s = get_session("local[8]", 8, app_name="shelfpulse-tests")
    checkpoint_dir(s)
    yield s
