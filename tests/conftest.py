import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tachyline.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tachyline-tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def place(spark):
    """A fresh folder path in the session's checkpoint area."""
    from tachyline.plans.files import scratch_path

    return scratch_path(spark, f"test-{uuid.uuid4().hex[:6]}")
