"""Streams of events: closed windows under a watermark, and blocks that fill across micro-batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonespark.functions.sample import float_to_int
from tonespark.operators import halo


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; unset and in local mode (tests), below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tonespark-")
    return f"{base.rstrip('/')}/tonespark-stream/{name}-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table as a stream of its files, oldest first."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/events.parquet*")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Write all that is available to Parquet in append mode and read it back."""
    path = shared_path(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def closed_windows(events: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and event type, each window once it has ended ``late`` before the latest event.

    Later rows of a window that was written are left out, as the watermark defines. Null times belong to no window.
    """
    made = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


OPEN = "user_id long, seen long, block long, low long, high long, total long, n long"


def full_blocks(events: DataFrame, name: str, length: int = 20, flush: bool = False) -> DataFrame:
    """``user_id, block, low, high, total`` of each block of ``length`` samples of the stream ``events``, once it is full;
    with ``flush`` also of the last, shorter ones when the stream has ended.

    Each micro-batch numbers its samples by event_id, sums them up by block, and adds to the open blocks that the batch
    before it left: a table of one row a user is all that is carried on. Batches have to come in the order of event_id.
    Tables are written under the number of their batch, so a batch that runs twice writes the same. Rows with a null
    user, id or value are left out.
    """
    spark, path = events.sparkSession, shared_path(events.sparkSession, name)

    def each(batch: DataFrame, number: int) -> None:
        whole = batch.where("user_id is not null and event_id is not null and value is not null")
        q = whole.select("user_id", "event_id", float_to_int(F.col("value") / 1024, 16).alias("q"))
        before = batch.sparkSession.read.schema(OPEN).parquet(f"{path}/open/{number - 1}") if number else batch.sparkSession.createDataFrame([], OPEN)
        placed = halo.numbered(q, "user_id", "event_id", "k").join(before.select("user_id", "seen"), "user_id", "left")
        block = F.floor((F.col("k") + F.coalesce("seen", F.lit(0))) / length).cast("long")
        sums = placed.groupBy("user_id", block.alias("block")).agg(F.min("q").alias("low"), F.max("q").alias("high"), F.sum("q").alias("total"), F.count("*").alias("n"))
        both = halo.merged(sums, before.where("n > 0").select("user_id", "block", "low", "high", "total", "n"), "user_id", "block")
        merged = both.groupBy("user_id", "block").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("n").alias("n"))
        merged.write.mode("overwrite").parquet(f"{path}/sums/{number}")
        merged = batch.sparkSession.read.schema(merged.schema).parquet(f"{path}/sums/{number}")
        merged.where(F.col("n") == length).write.mode("overwrite").parquet(f"{path}/full/batch={number}")
        # A user's last block, if it is full, stands for an open one without samples.
        last = merged.groupBy("user_id").agg(F.max_by(F.struct("block", "low", "high", "total", "n"), "block").alias("l")).select("user_id", "l.*")
        rest = before.join(last, "user_id", "left_anti")
        now = last.select("user_id", (F.col("block") * length + F.col("n")).alias("seen"), "block", "low", "high", "total", F.when(F.col("n") < length, F.col("n")).otherwise(0).alias("n"))
        now.unionByName(rest).write.mode("overwrite").parquet(f"{path}/open/{number}")

    query = events.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    made = "user_id long, block long, low long, high long, total long"
    if query.lastProgress is None:  # no batch at all
        return spark.createDataFrame([], made)
    out = spark.read.schema(made).option("recursiveFileLookup", "true").parquet(f"{path}/full")
    if flush:
        left = spark.read.schema(OPEN).parquet(f"{path}/open/{query.lastProgress.batchId}").where("n > 0")
        out = out.unionByName(left.select("user_id", "block", "low", "high", "total"))
    return out
