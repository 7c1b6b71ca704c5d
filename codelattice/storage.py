"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session of local threads gets a new local folder; on a
    cluster executors would not see each other's files, so that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
    if checkpoints.isEmpty():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
    return checkpoints.get().rstrip("/")


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the shared folder and read from there.

    Lineage ends here, lost executors cost no recomputation beyond the write,
    and Spark knows the size of what follows.
    """
    return _stored(frame)[0]


def _stored(frame: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_folder(frame.sparkSession)}/stored-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    held = _written.get()
    if held is not None:
        held.append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end, when all that reads it has run."""
    inner: list[str] = []
    token = _written.set(inner)
    try:
        yield
    finally:
        _written.reset(token)
        discard(spark, *inner)


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, stored; all that it stored on its way is deleted."""
    outer, inner = _written.get(), []
    token = _written.set(inner)
    try:
        out, path = _stored(make())
    finally:
        _written.reset(token)
    discard(spark, *(p for p in inner if p != path))
    if outer is not None:
        outer.append(path)
    return out
