"""Files that land in a folder, analysed batch by batch, with a status table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STEPS = (("parsing", 20), ("analysing", 40), ("optimising", 60), ("rendering", 80), ("done", 100))


def landing(spark: SparkSession, path: str, glob: str = "*", most: int = 1000) -> DataFrame:
    """New files of a folder as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", most).load(path)


def process(files: DataFrame, work: Callable[[DataFrame], DataFrame], output: str, status: str, checkpoint: str) -> StreamingQuery:
    """Run ``work`` on each batch of files: results go to ``output``, one status row a file to ``status``.

    A batch is written under its number, so one that is run again after a failure replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")
        done = batch.select("path", "length", F.lit("completed").alias("status"), F.lit(100).alias("progress"), F.lit(STEPS[-1][0]).alias("step"))
        done.write.mode("overwrite").parquet(f"{status}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
