from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cloakwork.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("cloakwork-tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """Build a (doc_id, text) table from a list of texts."""

    def build(*items):
        return spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")

    return build


@pytest.fixture(scope="session")
def small():
    return SMALL
