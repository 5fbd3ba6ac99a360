"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: str | None = None
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session that lacks it gets a folder of its own."""
    global _own
    found = spark.conf.get(_SETTING, None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    Unlike executor-local caching, what is written survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table by whatever file system its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at its end; what depends on them must be written by then."""
    before = len(_paths)
    try:
        yield
    finally:
        while len(_paths) > before:
            drop(spark, _paths.pop())
