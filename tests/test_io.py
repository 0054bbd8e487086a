"""Sources and sinks: CSV with either NA convention, views, table writes."""

import os
import tempfile

from carelog.sources.tables import EICU_SCHEMAS, create_view, export_csv, read_csv, read_table, write_table


def test_csv_roundtrip_na_conventions(spark):
    d = tempfile.mkdtemp(prefix="carelog-io-")
    df = spark.createDataFrame([(1, "Alive", 2.5), (2, None, None)], "id int, status string, v double")
    export_csv(df, os.path.join(d, "empty"), na="")
    back = read_csv(spark, os.path.join(d, "empty"), schema=df.schema, na="")
    assert sorted(back.collect()) == sorted(df.collect())
    export_csv(df, os.path.join(d, "na"), na="NA")
    back2 = read_csv(spark, os.path.join(d, "na"), schema=df.schema, na="NA")
    assert sorted(back2.collect()) == sorted(df.collect())


def test_view_and_table(spark):
    d = tempfile.mkdtemp(prefix="carelog-io-")
    df = spark.createDataFrame([(1, 10)], "patientunitstayid bigint, oobintubday1 int")
    create_view(df, "apv_test")
    assert spark.sql("select count(*) from apv_test").first()[0] == 1
    write_table(df, os.path.join(d, "apachepredvar.parquet"))
    back = read_table(spark, d, "apachepredvar", EICU_SCHEMAS["apachepredvar"])
    assert back.collect()[0].oobintubday1 == 10
