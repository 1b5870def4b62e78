"""Changes as a stream: appended rows drained in one run, and windowed counts with late data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, set if it isn't: the cluster's, or on a local master without one a new folder under /tmp."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def source(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream of its rows."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if spark.read.parquet(path).inputFiles()[0].rstrip("/").rpartition("/")[2] != name else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drained(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All rows that wait at `path`, through a stream that stops when it has caught up; each row exactly once."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    stream = source(spark, path).select(*columns).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type (works on a stream, with a watermark, and on a table)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def queue_head(products: DataFrame, most: int) -> DataFrame:
    """The oldest rows that wait to be sent."""
    return products.where(~F.col("is_synced")).orderBy("id").limit(most)
