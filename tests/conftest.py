from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["TZ"] = "UTC"

from logloom.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(4, memory="6g", shuffle_partitions=4, shared=f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture(scope="session")
def sf():
    return SF
