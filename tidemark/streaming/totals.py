"""The scans on streams: running totals of a grep, and windowed counts of an ordered stream.

Both drain what is there (availableNow) and agree with the batch operators on the same rows. State is one row a source or
a window; results are written by foreachBatch under the checkpoint folder that the executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming aggregate over all that is available and returns its last result as a table."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/result")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/result")


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the files of a path (a file or a folder)."""
    schema = spark.read.parquet(path).schema
    # a folder is streamed as it is; a bare file as the one file of its name in its folder, as the source wants a folder
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def stream_totals(stream: DataFrame, source: Column, text: Column, test: Callable[[Column], Column]) -> DataFrame:
    """Running rows and matched rows of each source."""
    return stream.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(test(text), F.lit(False))).alias("matched"))


def stream_windows(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Counts of each value in windows of time; rows later than ``late`` behind the newest are let go."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("rows"))
    return w.select(F.col("w.start").alias("start"), by, "rows")


def stream_distinct(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
