import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from meshwork.plans.session import build_session, checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="meshwork-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s)  # tests only: a scratch folder when none is configured
    yield s
    s.stop()
