import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corvid.session import build_session  # noqa: E402

# Spark's event log, read by the plan guard
EVENTS = tempfile.mkdtemp(prefix="corvid-events-")
os.environ["PYSPARK_SUBMIT_ARGS"] = (f"--conf spark.eventLog.enabled=true --conf spark.eventLog.dir=file://{EVENTS} "
                                     "--conf spark.eventLog.rolling.enabled=false --conf spark.eventLog.compress=false pyspark-shell")

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="corvid-tests")
    yield s
    s.stop()
