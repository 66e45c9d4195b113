import os
import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def _folder(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meshwork-llm-", dir=os.environ.get("TMPDIR", "/tmp")))


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
