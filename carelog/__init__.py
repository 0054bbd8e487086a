"""carelog: ICU cohort and phenotype analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a Column
builder) whose table and column names are parameters, so the same code runs
on any long-format event log.  Heavy work stays on Spark: joins, grouping,
windows and shuffles keyed by the stay id.

Layout
------
``functions``  Column expressions: safe parsing, rule classification, bands,
               time buckets, unit normalisation.
``operators``  DataFrame operators: event union/dedupe, gap sessions, nearest
               event in a bucket, top-1 picks, flags, statistics.
``sources``    table readers/writers and the eICU-shaped table derivation.
``plans``      the six study pipelines, the study report and the query
               catalogue used by ``__spark_entry__``.
``streaming``  the row-level event classifiers applied to a stream.
"""

from carelog.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
