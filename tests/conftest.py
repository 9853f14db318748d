from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pitlane.session import checkpoint_dir, local_session

    s = local_session("*", shuffle_partitions=8, app="pitlane-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from oracle_compare import SF_SMALL, duck

    return duck(SF_SMALL)
