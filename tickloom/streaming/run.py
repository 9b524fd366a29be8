"""Run a stream over files to its end, exactly once, and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import scratch


def file_stream(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """A streaming reader of a Parquet file or folder, with the schema it has now."""
    r = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", True)
    if most_files:
        r = r.option("maxFilesPerTrigger", most_files)
    return r.parquet(path[:-1] + "[" + path[-1] + "]")  # a pattern, since the source takes folders and patterns


def drained(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Everything there is now, through a checkpointed Parquet sink; nothing passes through the driver.

    ``at`` is the folder of sink and checkpoint: a later call with the same one goes on from
    where the last ended, with its state, and gives all rows so far, each once. Without it the
    run is on its own, in the shared folder.
    """
    spark = stream.sparkSession
    at = at or scratch(spark, f"stream-{name}")
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{at}/out")
        .option("checkpointLocation", f"{at}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
