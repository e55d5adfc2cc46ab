import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from webtally.session import CHECKPOINT_DIR, local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=8, memory="6g")
    if session.conf.get(CHECKPOINT_DIR, None) is None:
        session.stop()
        session = local_session(cores=8, memory="6g", checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    session.conf.set("spark.sql.maxMetadataStringLength", 1000)  # plans name tables whole, wherever temporary folders are
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.01"
