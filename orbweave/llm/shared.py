"""What several operators share: the checkpoint folder, written tables and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import words


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where that setting is absent, a folder of our own serves a local master (driver and executors are one process); on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="orbweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/orbweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._orbweave_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a table made by written() that no later plan reads."""
    path = getattr(df, "_orbweave_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column is called so in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def release_memory() -> None:
    """Give a Python worker's free memory back, so that idle workers don't hold the peak of their last task."""
    import ctypes

    import pyarrow as pa

    words.forget_powers()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(function):
    """function, followed by release_memory()."""

    def run(table):
        try:
            return function(table)
        finally:
            release_memory()

    return run


