"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelog.session import checkpoint_dir

#: White space that separates words, and ASCII case folding.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UP_TO_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())


#: Rows of a batch sent to Python at most: texts are long, and batches are held in both processes.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows; a lower setting stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


_SCRATCH: list[list[DataFrame]] = []


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The written table cuts the lineage, is visible to every executor, and goes
    when the application ends, or with the ``scratch()`` block that it is written
    in (``keep``: with the block around that one).
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    blocks = _SCRATCH[:-1] if keep else _SCRATCH
    if blocks:
        blocks[-1].append(out)
    return out


@contextmanager
def scratch():
    """Tables saved inside go at the end: nothing that is returned may read them."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        discard(*_SCRATCH.pop())


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``saved()`` that no later result reads."""
    for df in frames:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now.

    It does so once the driver has collected the plans, which a large heap puts off
    for long; meant for a few places where much has been shuffled.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            yield b.slice(a, z - a)


def tidy(run):
    """``run`` (batches in, batches out), with its memory given back when it ends.

    Python workers are reused, and what the allocators keep would count against the
    tasks that come after.
    """
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return tidied


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(text).to_pylist()]


def lower_bytes(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased (other letters stay)."""
    return text.encode("utf-8", "surrogatepass").translate(_UP_TO_LOW)


def append(batch: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])


#: Bits of the bitmap that ``likely()`` sends out: 1 MB, whatever the data.
FILTER_BITS = 23


def likely(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be in the only column of ``wanted``, of the same type.

    A bitmap of fixed size holds the hashed values, so no wanted row is lost and
    most others stay out of the shuffle of the join that follows.
    """
    cells = 1 << FILTER_BITS
    got = (wanted.select(F.pmod(F.xxhash64(wanted.columns[0]), F.lit(cells)).alias("c"))
           .groupBy(F.expr("bitmap_bucket_number(c + 1)").alias("b"))
           .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c + 1))").alias("bits")).collect())
    bits = np.zeros(cells // 8, np.uint8)
    for r in got:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["b"] - 1) * len(part):r["b"] * len(part)] = part
    name = free_name(df, "cell")

    def run(batches):
        for b in batches:
            at = b.column(name).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool))).drop_columns([name])

    keyed = df.withColumn(name, F.pmod(F.xxhash64(column), F.lit(cells)))
    return keyed.mapInArrow(tidy(run), df.schema)
