import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from carelog.session import get_spark

    builder_conf = {"spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    active = SparkSession.getActiveSession()
    if active is None or not active.conf.get("spark.checkpoint.dir", None):
        # tests only: a private checkpoint folder when the session names none
        builder_conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="carelog-test-")
    s = get_spark("local[4]", 8, app="carelog-tests", extra=builder_conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows(df, *cols):
    """Collected rows as tuples (sorted) - test helper for small results."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
