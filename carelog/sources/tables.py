"""Table readers and writers (scans, views, CTAS-style writes, CSV)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _D, _S, _B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Input tables of the study, long format; offsets are minutes from ICU admission.
EICU_SCHEMAS: dict[str, T.StructType] = {
    "respiratorycharting": _schema(("patientunitstayid", _L), ("respchartoffset", _L),
                                   ("respchartvaluelabel", _S), ("respchartvalue", _S)),
    "nursecharting": _schema(("patientunitstayid", _L), ("nursingchartoffset", _L),
                             ("nursingchartentryoffset", _L), ("nursingchartcelltypevallabel", _S),
                             ("nursingchartvalue", _S)),
    "patient": _schema(("patientunitstayid", _L), ("patienthealthsystemstayid", _L), ("gender", _S),
                       ("age", _S), ("ethnicity", _S), ("unitdischargeoffset", _L),
                       ("hospitaladmitoffset", _L), ("hospitaldischargeoffset", _L),
                       ("unitadmitsource", _S), ("unitdischargestatus", _S),
                       ("hospitaldischargestatus", _S), ("admissionheight", _D),
                       ("admissionweight", _D), ("dischargeweight", _D)),
    "treatment": _schema(("patientunitstayid", _L), ("treatmentoffset", _L), ("treatmentstring", _S),
                         ("activeupondischarge", _B)),
    "lab": _schema(("patientunitstayid", _L), ("labresultoffset", _L), ("labname", _S), ("labresult", _D)),
    "vitalperiodic": _schema(("patientunitstayid", _L), ("observationoffset", _L), ("temperature", _D),
                             ("heartrate", _I), ("respiration", _I), ("systemicmean", _I),
                             ("systemicsystolic", _I), ("systemicdiastolic", _I), ("sao2", _I)),
    "vitalaperiodic": _schema(("patientunitstayid", _L), ("observationoffset", _L), ("noninvasivemean", _I)),
    "infusiondrug": _schema(("patientunitstayid", _L), ("infusionoffset", _L), ("drugname", _S), ("drugrate", _S)),
    "respiratorycare": _schema(("patientunitstayid", _L), ("respcarestatusoffset", _L), ("airwaytype", _S)),
    "careplangeneral": _schema(("patientunitstayid", _L), ("cplitemoffset", _L), ("cplitemvalue", _S)),
    "physicalexam": _schema(("patientunitstayid", _L), ("physicalexamoffset", _L), ("physicalexampath", _S),
                            ("physicalexamvalue", _S)),
    "diagnosis": _schema(("patientunitstayid", _L), ("diagnosisstring", _S), ("icd9code", _S)),
    "intakeoutput": _schema(("patientunitstayid", _L), ("intakeoutputoffset", _L), ("outputtotal", _D)),
    "apachepredvar": _schema(("patientunitstayid", _L), ("oobintubday1", _I)),
}

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, base: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan of ``{base}/{name}.parquet`` (a file or a folder).

    Column pruning and filter pushdown reach the scan because callers only
    select/filter on plain columns.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(os.path.join(base, f"{name}.parquet"))


def read_tables(spark: SparkSession, base: str, names=DRIVER_TABLES) -> dict[str, DataFrame]:
    return {n: read_table(spark, base, n) for n in names}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             na: str = "") -> DataFrame:
    """CSV with a header.  ``na`` is the text read as NULL: ``""`` or ``"NA"``."""
    reader = spark.read.option("header", True).option("nullValue", na)
    if na != "":
        # an empty field stays an empty string only when it is not the NA mark
        reader = reader.option("emptyValue", "")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def create_view(df: DataFrame, name: str) -> DataFrame:
    """Drop-and-create view: the plan stays lazy and is re-evaluated per use."""
    df.createOrReplaceTempView(name)
    return df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Drop-and-create table as select (overwrite)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_csv(df: DataFrame, path: str, na: str = "") -> None:
    """Result export for tools that read CSV; one file per output partition."""
    df.write.mode("overwrite").option("header", True).option("nullValue", na).csv(path)
