"""Shared plumbing of the training-data operators.

Intermediate tables are cut into the folder named by ``spark.checkpoint.dir``,
which driver and executors share, so a lost executor costs a recomputed stage
and never a lost block.
"""

from __future__ import annotations

import ctypes
import gc
import itertools
import os
import tempfile
import threading
import zipfile
from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COUNTER = itertools.count()
#: Columns of word hashes repeat a file's vocabulary, so their dictionary may be larger than by default.
DICTIONARY_BYTES = 4 << 20
#: Spark's option that removes an execution's shuffles from disk at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables, under the shared
    checkpoint folder. A folder beside the warehouse is used only where the
    session names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"
    return f"{base.rstrip('/')}/mvmap-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{next(_COUNTER):05d}-{name}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there. The
    shuffles that made it go from disk with the write, not when the driver collects garbage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).option("parquet.dictionary.page.size", DICTIONARY_BYTES).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``materialise`` that no frame reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner see that the shuffles of frames which are gone are unused:
    one collection on the driver, after a stage whose shuffle is as large as its input.
    Frames in reference cycles are gone after one of Python's own."""
    gc.collect()
    spark._jvm.System.gc()


def purge(spark: SparkSession) -> bool:
    """Delete the application's intermediate tables. Frames built on them can
    no longer be evaluated afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors once per application, so that
    they need no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="mvmap-"), "mvmap-src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)


#: Seconds without a task after which a Python worker gives up its memos.
IDLE = 2.0
_DROPS: list[Callable[[], None]] = []
_TIMERS: list[threading.Timer] = []
#: Free memory that a working process keeps, and the size from which an array is mapped on its own: else
#: each block of a task has its pages faulted in and zeroed again.
SPARE, MAPPED = 128 << 20, 32 << 20


def at_rest(drop: Callable[[], None]) -> None:
    """Have ``drop`` called in a worker that rests; a running task keeps what it holds."""
    _DROPS.append(drop)


def rest() -> None:
    """Drop the worker's memos and hand free memory back to the system: idle workers
    stand beside the executor's heap, which other stages fill."""
    import pyarrow as pa

    for drop in _DROPS:
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@cache
def keep_spare() -> bool:
    """Have the allocator keep ``SPARE``; once in a worker, which gives it back at rest."""
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    trim_threshold, mmap_threshold = -1, -3
    return bool(tune and tune(mmap_threshold, MAPPED) and tune(trim_threshold, SPARE))


def task(batches, fn):
    """The batches of ``fn``; the worker rests if no other task follows within ``IDLE``."""
    keep_spare()
    while _TIMERS:
        _TIMERS.pop().cancel()
    try:
        yield from fn(batches)
    finally:
        timer = threading.Timer(IDLE, rest)
        timer.daemon = True
        _TIMERS.append(timer)
        timer.start()


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(partial(task, fn=fn), schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bit_filter(keys: DataFrame, column: str, min_bits: int = 1 << 16, max_bits: int = 1 << 27) -> tuple[bytes, int]:
    """A one-hash Bloom filter over a bigint column, made by a distributed
    bit_or and fetched as at most ``max_bits`` bits (16 MiB). It only prunes:
    a false hit is removed by the join that follows, so results never depend
    on its size."""
    n = keys.count()
    bits = min_bits
    while bits < 16 * n and bits < max_bits:
        bits *= 2
    slot = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    words = (
        keys.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    import numpy as np

    out = np.zeros(bits // 64, dtype="<i8")
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes(), bits
