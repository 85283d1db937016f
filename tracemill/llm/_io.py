"""Scratch tables in the cluster's shared folder, and small plan helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there,
    and the loss of an executor costs at most the running stage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut`, once nothing lazy reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_dir(spark).rstrip("/").removeprefix("file://")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of an Arrow batch, the same for every operator here, so that plans that run later go by them too.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of long texts can hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Of this Python worker: the operator that it works for last, and what it keeps from task to task for that.
_kept: dict[str, dict] = {}


def turn_to(operator: str) -> dict:
    """What this worker keeps for ``operator``. What it kept for another one goes back to the system, and so does what its allocators
    hold unused: workers live as long as their executor, so tables of one stage would lie beside those of all later ones."""
    if operator not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError, TypeError):  # another C library than glibc
            ctypes.CDLL(None).malloc_trim(0)
        _kept[operator] = {}
    return _kept[operator]


def rank_in(splitters: list[int], key: Column) -> Column:
    """How many of the sorted ``splitters`` are <= ``key``: a binary search inside the plan."""
    width = 1
    while width <= len(splitters):
        width *= 2
    top = (1 << 63) - 1
    arr = F.array(*[F.lit(s).cast("long") for s in splitters + [top] * (width - len(splitters))])
    steps = []
    while width > 1:
        width //= 2
        steps.append(F.lit(width))
    if not steps:
        return F.lit(0)
    found = F.aggregate(
        F.array(*steps), F.lit(0), lambda at, step: F.when(F.get(arr, at + step - 1) <= key, at + step).otherwise(at)
    )
    return F.least(found, F.lit(len(splitters)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
