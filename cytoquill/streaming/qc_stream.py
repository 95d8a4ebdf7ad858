"""Running totals of cells from a stream of count rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_totals(counts: DataFrame) -> DataFrame:
    """``cell_id, total_counts`` of a stream (cell_id, n): one sum for each cell is kept as state."""
    return counts.groupBy("cell_id").agg(F.sum("n").alias("total_counts"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; windows close once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def read_stream(spark: SparkSession, folder: str, name: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files called ``name`` under a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(folder)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the table it wrote, each result once.

    ``complete``: the last batch's table; ``append``: all batches. Offsets and state lie beside
    the table in the shared folder, so a broken run goes on where it stopped.
    """
    spark = stream.sparkSession
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table" if mode == "complete" else f"{at}/table/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{at}/table")
    return out.drop("batch") if mode == "append" else out
