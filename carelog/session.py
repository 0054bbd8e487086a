"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Settings a job needs regardless of cluster size.  AQE re-plans joins from
# runtime sizes (broadcast only when the materialised side is small) and
# splits skewed partitions of sort-merge joins.
_JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "carelog", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the job settings applied.

    ``master`` and ``shuffle_partitions`` are only for local runs and tests; on
    a cluster both come from the submit configuration.
    """
    builder = (SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**_JOB_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in _JOB_CONF.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used.  Without one, a private temporary folder
    serves local runs and tests; elsewhere executors would write to their own disks,
    so this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="carelog-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def _path(spark: SparkSession, path: str):
    """Hadoop path and its file system (any store that Spark reads)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    """A finished write lies at ``path``."""
    where, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def fingerprint(spark: SparkSession, paths: list[str], *more: str) -> str:
    """Changes when a file anywhere below ``paths`` changes in name, size or time, or ``more`` does."""
    found = []
    for path in paths:
        where, fs = _path(spark, path)
        files = []
        for f in fs.globStatus(where) or []:
            below = fs.listFiles(f.getPath(), True)
            while below.hasNext():
                x = below.next()
                files.append((str(x.getPath()), x.getLen(), x.getModificationTime()))
        found += sorted(files)
    return hashlib.sha1(repr((found, more)).encode()).hexdigest()[:16]


#: Tables of other keys are removed when they are this old: a running job may still read a younger one.
STALE_MS = 24 * 3600 * 1000
_SCHEMA = "_step_schema.json"


def _read_text(spark: SparkSession, path: str) -> str | None:
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _path(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def source_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of all files below ``paths``."""
    total = 0
    for path in paths:
        where, fs = _path(spark, path)
        total += sum(fs.getContentSummary(f.getPath()).getLength() for f in fs.globStatus(where) or [])
    return total


def bucket_count(total: int, target: int = 256 << 20, least: int = 8, most: int = 1 << 16) -> int:
    """Buckets for tables of one study: a power of two, about ``target`` bytes of the sources in each.

    All tables of a study have the same number, so joins on the bucket column meet without a shuffle.
    """
    return min(most, max(least, 1 << max(0, (total // target)).bit_length()))


def step_table(spark: SparkSession, name: str, key: str, make, by: str | None = None, buckets: int = 0,
               placed: bool = False) -> DataFrame:
    """The table ``name`` for ``key``: written once from ``make()``, then read by all later steps.

    Cuts lineage (a lost executor recomputes from the written table), keeps later
    plans small, and lets AQE see real sizes.  A finished table is found by one look
    at the folder; its schema lies beside the data, so nothing is planned or inferred.
    The write goes to a folder of its own and is published by a rename, so readers see a
    whole table or none; of two writers at once the first to finish wins, and the other
    takes the winner's table.

    With ``by`` the table is laid out in ``buckets`` hash buckets of that column, sorted
    by it: aggregates and joins on the column read it without a shuffle.  ``placed`` says
    that ``make()`` only selects from one such table, so its buckets are written in place.
    """
    base = f"{checkpoint_dir(spark)}/carelog-tables/{name}"
    path = f"{base}/{key}"
    found = _read_text(spark, f"{path}/{_SCHEMA}")
    if found is None:
        df = make()
        staged = f"{base}/.staged-{uuid.uuid4().hex}"
        if by:
            draft = f"carelog_draft_{uuid.uuid4().hex}"
            writer = (df if placed else df.repartition(buckets, by)).write.bucketBy(buckets, by).sortBy(by)
            writer = writer.option("path", staged).format("parquet")
            if placed:
                _by_bucket(spark, lambda: writer.saveAsTable(draft))
            else:
                writer.saveAsTable(draft)
            spark.sql(f"DROP TABLE {draft}")  # external: the files stay
        else:
            df.write.parquet(staged)
        found = json.dumps({"schema": json.loads(df.schema.json()), "by": by, "buckets": buckets})
        _write_text(spark, f"{staged}/{_SCHEMA}", found)
        (there, fs), (here, _) = _path(spark, path), _path(spark, staged)
        # a rename onto a folder that has come into being would move into it: then the other writer's table stands
        if fs.exists(there) or not fs.rename(here, there):
            fs.delete(here, True)
            found = _read_text(spark, f"{path}/{_SCHEMA}")
        else:
            nested, _ = _path(spark, f"{path}/{here.getName()}")
            if fs.exists(nested):
                fs.delete(nested, True)
        _drop_stale(spark, base, key)
    found = json.loads(found)
    schema = StructType.fromJson(found["schema"])
    if not found["by"]:
        return spark.read.schema(schema).parquet(path)
    table = "carelog_" + hashlib.sha1(path.encode()).hexdigest()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (`{found['by']}`) "
              f"SORTED BY (`{found['by']}`) INTO {found['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def _by_bucket(spark: SparkSession, run) -> None:
    """Runs a job whose scan takes one task for each bucket, though nothing in its plan joins or groups by it."""
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        run()
    finally:
        spark.conf.set(name, before)


def _drop_stale(spark: SparkSession, base: str, key: str) -> None:
    """Removes old tables of the same sources' folder (the part of the key before '-') under another key."""
    where, fs = _path(spark, base)
    for other in fs.listStatus(where):
        name = other.getPath().getName()
        alike = name.startswith(".staged-") or name.split("-")[0] == key.split("-")[0]
        if alike and name != key and other.getModificationTime() < time.time() * 1000 - STALE_MS:
            fs.delete(other.getPath(), True)
