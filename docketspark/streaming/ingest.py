"""Incremental ingestion with Structured Streaming: each new file once, latest state of jobs, events in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str, delay: str = "7 days") -> DataFrame:
    """A stream of files, each content once within the watermark."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(root)
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    return hashed.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])


def table_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream over the Parquet files of ``path``, a folder or one file of its folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(like.schema)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def ingest(stream: DataFrame, known_path: str, checkpoint: str, store: Callable[[DataFrame], None], key: str = "sha256") -> StreamingQuery:
    """Stores what is new in each batch and appends its keys to ``known_path``.

    The keys' files are named by batch, so a batch that runs again after a failure replaces its own and stores nothing twice
    that ``store`` itself keeps by key.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        earlier = spark.read.schema(f"{key} string, batch long").parquet(known_path) if _exists(spark, known_path) else spark.createDataFrame([], f"{key} string, batch long")
        fresh = rows.dropDuplicates([key]).join(earlier.filter(F.col("batch") != number).select(key), key, "left_anti").persist()
        store(fresh)
        fresh.select(key).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(known_path)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events by window and kind; late ones count until the watermark has passed."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Sessions of users that end after ``gap`` without an event."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")
