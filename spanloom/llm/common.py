"""What the operators of this subpackage share: the shared folder, text columns and id arrays."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The folder is ``spark.checkpoint.dir``. Where the session names none, a temporary folder
    is made and set on a local master, as in tests; any other master is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver's JVM happens to collect its plan.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the time of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts lineage and outlives executors. The shuffle files that the write needed go at its end."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    with setting(spark, FILES_GO, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``keep`` wrote, once nothing that is still to be computed reads them."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slim(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Has Spark hand rows with whole texts or sets to Python by the thousand and by 4 MB: JVM and worker each hold a batch as a whole, and at 64 MB, Spark's own bound, a worker with both sides of a join takes hundreds of megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def light(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``df``, a few narrow columns already written, marked for broadcast if it has no more than ``most`` rows; beyond that both sides are shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def hash_share(column: str, share: float) -> Column:
    """A set share of the rows, chosen by a hash."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def uint32(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u4")


def list_array(parts: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit ids of each row as an Arrow list of integers, without a Python object for each id."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def list_bytes(column: pa.Array) -> list[bytes]:
    """The reverse of list_array."""
    flat, offsets = np.asarray(column.values), np.asarray(column.offsets)
    return [flat[a:b].astype("<u4", copy=False).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]


def small_batches(batches, limit: int = 8 << 20, column: str = "text"):
    """Arrow batches cut so that each holds about ``limit`` bytes of ``column``; a longer row stands alone. At the end the worker, which Spark keeps, gives memory back."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
    give_back()


def give_back() -> None:
    """Returns what Arrow and the C library hold in reserve."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def hold_freed(most: int = 24 << 20) -> None:
    """Has the C library keep up to ``most`` freed bytes for the next arrays. Else work in steps on arrays of a megabyte has the system make their pages anew at each step. ``give_back`` still returns them."""
    with contextlib.suppress(OSError, AttributeError):
        library = ctypes.CDLL(None)
        library.mallopt(-3, most // 2)  # M_MMAP_THRESHOLD
        library.mallopt(-1, most)  # M_TRIM_THRESHOLD
