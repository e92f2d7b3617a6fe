"""What the operators share: the shared folder, written intermediate tables, column checks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.session import ship

#: The white space of the contracts, [\x20\x09-\x0D].
SPACES = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset in local mode (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="quarrylight-")
        atexit.register(_remove_local, _own["dir"])
    return _own["dir"]


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever store it lies in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables written to the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*by) if by else w).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for n in names:
            remove(self.spark, self.path(n))

    def release(self) -> None:
        """Let Spark delete the shuffle files of what is no longer referred to."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return a Python worker's free memory to the system: workers are kept for later tasks, beside others of their executor."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(f):
    """f, a function over the batches of a task, that gives memory back when the task is through."""

    def g(batches):
        yield from f(batches)
        give_back()

    return g


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that a computed column of the same name (in any case) replaces."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def need(df: DataFrame, *names: str) -> None:
    """Check df's columns, and see to it that its executors have this package."""
    ship(df.sparkSession)
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
