"""Chunked ingest of points: bucket summaries that grow with every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrille.functions import geo


def summarise(points: DataFrame, level: int = 13) -> DataFrame:
    keyed = points.select(geo.tile_x("lon", level).alias("tx"), geo.tile_y("lat", level).alias("ty"), "lon", "lat", "h")
    return keyed.groupBy("tx", "ty").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("lon", "lat", "h") for f, n in ((F.min, "min"), (F.max, "max"))])


def merged(parts: DataFrame) -> DataFrame:
    """One row per bucket from partial summaries of any number of batches."""
    return parts.groupBy("tx", "ty").agg(F.sum("n").alias("n"), *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("lon", "lat", "h") for f, n in ((F.min, "min"), (F.max, "max"))])


def stream_summaries(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, level: int = 13) -> StreamingQuery:
    """Read point files as they come; write one partial summary per batch, under its batch id, so that a repeated batch replaces itself."""
    points = spark.readStream.schema(schema).parquet(source)

    def put(batch: DataFrame, batch_id: int) -> None:
        summarise(batch, level).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return points.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
