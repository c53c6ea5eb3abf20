import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tabsight.session import build_session, ensure_checkpoint_dir
    s = build_session("local[4]", app="tabsight-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g"})
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tabsight-test-")
