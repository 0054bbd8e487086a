"""Oxygen-support event codes from charting files as they arrive."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carelog.plans.oxygen import support_events
from carelog.session import checkpoint_dir
from carelog.sources.tables import EICU_SCHEMAS


def support_event_stream(spark: SparkSession, resp_dir: str, nurse_dir: str, treatment_dir: str,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of (stay, charttime, code, supp, active) rows with a
    code, read from three parquet folders (explicit schemas, no inference)."""
    def src(path, name):
        r = spark.readStream.schema(EICU_SCHEMAS[name])
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.parquet(path)

    ev = support_events(src(resp_dir, "respiratorycharting"), src(nurse_dir, "nursecharting"),
                        src(treatment_dir, "treatment"))
    return ev.filter(F.col("code").isNotNull())


def start_support_event_stream(stream: DataFrame, sink_dir: str, name: str = "support-events",
                               available_now: bool = True) -> StreamingQuery:
    """Append the stream to parquet; progress is kept under the session's
    checkpoint folder so a restarted job resumes where it stopped."""
    spark = stream.sparkSession
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", ckpt).option("path", sink_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
