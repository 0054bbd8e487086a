"""The stateless support-event classifier on a file stream equals the batch run."""

import os
import tempfile

from pyspark.sql import functions as F

from carelog.plans.oxygen import support_events
from carelog.sources.fixtures import derive
from carelog.streaming import start_support_event_stream, support_event_stream
from tests.conftest import SF001


def test_stream_matches_batch(spark):
    t = derive(spark, SF001)
    d = tempfile.mkdtemp(prefix="carelog-stream-")
    for name in ("respiratorycharting", "nursecharting", "treatment"):
        t[name].write.parquet(os.path.join(d, name))
    stream = support_event_stream(spark, os.path.join(d, "respiratorycharting"), os.path.join(d, "nursecharting"),
                                  os.path.join(d, "treatment"), max_files_per_trigger=2)
    q = start_support_event_stream(stream, os.path.join(d, "sink"), name=f"test-{os.path.basename(d)}")
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(d, "sink"))
    batch = support_events(t["respiratorycharting"], t["nursecharting"], t["treatment"]).filter(
        F.col("code").isNotNull())
    cols = ["patientunitstayid", "charttime", "code", "supp"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
