"""Events as a stream of stack frames, joined with the catalog as they come.

The catalog is a batch table; each micro-batch joins it anew. Beyond what a
catalog service answers from its tables, this serves frames as they arrive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.sources.catalog import from_orders
from codelattice.storage import shared_folder

CALLS = {"click": "handle1", "view": "handle2", "purchase": "handle3", "signup": "handle9"}


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def frames_of(events: DataFrame) -> DataFrame:
    """(event_id, ts, class_id, failed, method_name) of events, batch or stream."""
    name = F.lit("dispatch")
    for kind, method in CALLS.items():
        name = F.when(F.col("event_type") == kind, method).otherwise(name)
    return events.select("event_id", "ts", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("class_id"), (F.col("event_type") == "error").alias("failed"), name.alias("method_name"))


def _batches(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What the stream yields over all that is there, with its ``batch``.

    A batch that is run again after a failure overwrites its own folder.
    """
    path = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-state").foreachBatch(write).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(path)


def enrich_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the class and method of its frame, through a stream-static join."""
    catalog = from_orders(spark, sf_dir)
    classes = catalog.classes.select(F.col("id").alias("class_id"), "full_class_name", "class_type")
    methods = catalog.methods.select("class_id", "method_name").distinct().withColumn("known", F.lit(True))
    joined = frames_of(event_stream(spark, sf_dir)).join(classes, "class_id", "left").join(methods, ["class_id", "method_name"], "left")
    rows = joined.select(
        "event_id",
        F.when(F.col("failed"), "org.ext.Dispatcher").otherwise(F.col("full_class_name")).alias("class_name"),
        "method_name",
        F.when(~F.col("failed"), F.col("class_type")).alias("class_type"),
        (~F.col("failed") & F.coalesce("known", F.lit(False))).alias("found"),
    )
    return _batches(rows, "append", "frames").drop("batch")


def count_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and kind; a batch updates the days that it touches.

    The stream waits a day for late events: a day that lies further back than
    that behind the latest event is closed, its state goes, and what comes later
    for it is dropped. Of the updates of a day the last one counts.
    """
    timed = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    counted = timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events"))
    updates = _batches(counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "events"), "update", "counts")
    return updates.groupBy("day", "event_type").agg(F.max_by("events", "batch").alias("events"))
