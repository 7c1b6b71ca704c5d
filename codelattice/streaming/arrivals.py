"""Source files as a stream of arrivals, of which each run reads only those that are new.

A folder holds ``files`` (what arrived, as Parquet), ``state`` (the stream's
checkpoint, with the digest of every path in its state store) and ``changes``
(what each batch found). Neither listing is compared with the other: a path
meets its own digest in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

ARRIVAL = "arrival long, project_id string, path string, content string"
CHANGE = f"{ARRIVAL}, change string"


def arrive(files: DataFrame, folder: str, arrival: int) -> None:
    """Adds files (project_id, path, content) to a folder; a null content says that the path is gone.

    ``arrival`` grows from one to the next; of several in one batch they are taken in that order.
    """
    rows = files.select(F.lit(arrival).cast("long").alias("arrival"), "project_id", "path", "content")
    rows.write.mode("append").parquet(f"{folder}/files")


def _judged(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What each arrival of one path is against the one before it: added, modified, deleted or same."""
    known = state.get[0] if state.exists else None
    held = list(frames)
    rows = held[0] if len(held) == 1 else pd.concat(held)
    if len(rows) > 1:  # most paths arrive once a batch, and nothing is done for them that one row does not need
        rows = rows.sort_values("arrival", kind="stable")
    changes = []
    for digest in rows["digest"].tolist():
        digest = digest if isinstance(digest, str) else None
        changes.append("same" if digest == known else "deleted" if digest is None else "added" if known is None else "modified")
        known = digest
    if known is not None:
        state.update((known,))
    elif state.exists:
        state.remove()
    n = len(changes)
    yield pd.DataFrame({"arrival": rows["arrival"].to_numpy(), "project_id": [key[0]] * n, "path": [key[1]] * n, "content": rows["content"].to_numpy(), "change": changes})


def file_changes(arrivals: DataFrame) -> DataFrame:
    """A stream of (arrival, project_id, path, content, change); the state store holds a digest for each path that is there."""
    digested = arrivals.filter(F.col("project_id").isNotNull() & F.col("path").isNotNull()).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    return digested.groupBy("project_id", "path").applyInPandasWithState(_judged, CHANGE, "digest string", "append", "NoTimeout")


def read_arrivals(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The changes of all that arrived since the last run, with their ``batch``, and how many rows this run read.

    A run that fails is made good by the next: a batch that is run again
    overwrites its own folder.
    """
    numbers = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
        numbers.append(number)

    stream = file_changes(spark.readStream.schema(ARRIVAL).parquet(f"{folder}/files"))
    run = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(write).start()
    run.awaitTermination()
    read = sum(p.numInputRows for p in run.recentProgress)
    return (all_changes(spark, folder).filter(F.col("batch").isin(*numbers)) if numbers else spark.createDataFrame([], f"{CHANGE}, batch long")), read


def all_changes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{CHANGE}, batch long").parquet(f"{folder}/changes")


def files_after(changes: DataFrame) -> DataFrame:
    """(project_id, path, length, content) of the files that are there after ``changes``."""
    last = changes.groupBy("project_id", "path").agg(F.max_by("content", F.struct("batch", "arrival")).alias("content"), F.max_by("change", F.struct("batch", "arrival")).alias("change"))
    held = last.filter("content is not null")
    return held.select("project_id", "path", F.octet_length("content").cast("long").alias("length"), "content")
