"""Structured Streaming forms of the polling loops: process-once, keyed state, windows, look-ahead.

Each function takes a streaming DataFrame and gives a streaming DataFrame or writes through ``foreachBatch``; all state
hangs on the checkpoint, so a lost executor or a restart replays the last batch and ends in the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vahini.operators.upsert import merge_upsert
from vahini.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed parquet files as a stream, at most so many files a batch (the rate cap of a poll)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A single file is read through its folder, since a file stream watches folders.
    folder, _, name = path.rpartition("/")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def once(events: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """The first of events with equal keys within the watermark; retries and replays add nothing."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, by: list[str], size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per tumbling window; what comes later than the watermark is left out."""
    w = F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def later_counterparts(originals: DataFrame, later: DataFrame, key: str, days: int = 180) -> DataFrame:
    """Stream-stream interval join: rows of ``later`` up to so many days after an original of the same key.

    Both have (key, id, at). The watermarks let Spark drop originals whose window is over.
    """
    a = originals.select(F.col(key).alias("ka"), F.col("id").alias("id"), F.col("at").alias("at_a")).withWatermark("at_a", "1 day")
    b = later.select(F.col(key).alias("kb"), F.col("id").alias("later_id"), F.col("at").alias("at_b")).withWatermark("at_b", "1 day")
    on = (F.col("ka") == F.col("kb")) & (F.col("at_b") > F.col("at_a")) & (F.col("at_b") <= F.col("at_a") + F.expr(f"INTERVAL {days} DAYS"))
    return a.join(b, on).select("id", "later_id", "at_a", "at_b")


def transitions(events: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """(key, previous, current) whenever a key's state changes, with the last state kept per key. Within a micro-batch by ``order``."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        last = kept.get[0] if kept.exists else None
        out = []
        # A key's events of one micro-batch are few.
        for now in pd.concat(list(batches)).sort_values("at", kind="stable")["state"]:
            if now is not None and now != last:
                out.append((k[0], last, now))
                last = now
        if last is not None:
            kept.update((last,))
        yield pd.DataFrame(out, columns=["key", "previous", "current"])

    rows = events.select(F.col(key).alias("key"), F.col(state).alias("state"), F.col(order).alias("at")).filter("key IS NOT NULL")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, previous string, current string", "last string", "append", GroupStateTimeout.NoTimeout)


def _folders(spark: SparkSession, path: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()] if fs.exists(at) else []


def latest(spark: SparkSession, path: str, below: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The table that ``upsert_sink`` keeps: of every bucket its last version (before ``below``); None if nothing is there."""
    held: dict[int, int] = {}
    for v in sorted(int(x[2:]) for x in _folders(spark, path) if x.startswith("v=")):
        if below is None or v < below:
            held |= {int(x[7:]): v for x in _folders(spark, f"{path}/v={v}") if x.startswith("bucket=")}
    paths = [f"{path}/v={v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def upsert_sink(stream: DataFrame, path: str, keys: list[str], keep_first: list[str], order: list[str], buckets: int = 64):
    """Keyed latest state in buckets of keys: a micro-batch writes a new version of the buckets it touches, and of no other.

    ``path/v=<batch id>/bucket=<b>``, read with ``latest``; a replayed batch writes the same again.
    """
    spark = stream.sparkSession
    number_of = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        touched = [r.b for r in batch.select(number_of.alias("b")).distinct().collect()]  # at most so many as buckets
        old = latest(spark, path, number, touched)
        old = spark.createDataFrame([], batch.schema) if old is None else old
        merged = merge_upsert(old, batch, keys, keep_first=keep_first, order=order).withColumn("bucket", number_of)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(write)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that has landed, into a table in the shared folder, and read that."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path))
    writer.option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
