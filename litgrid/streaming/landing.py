"""Tables that land in a folder over time: the same cell scan as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.sources.html_tables import html_cells


def pages_stream(spark: SparkSession, folder: str, schema: str = "page_id bigint, html string", files: int = 100) -> DataFrame:
    """Cells of the pages in parquet files that land in a folder."""
    return html_cells(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder))


def into(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, once: bool = True):
    """Writes each batch, transformed, under its number; a batch that is repeated after a failure overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        out = transform(df) if transform else df
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(spark: SparkSession, folder: str, schema: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per window and type of a landing folder, late rows within the watermark included."""
    events = spark.readStream.schema(schema).parquet(folder)
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
