"""Signature matching over streams, and counts per window of event time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalar import col, numeric_columns, positive


def match_signatures(flows: DataFrame, groups: list[tuple[int, list[str]]]) -> DataFrame:
    """``flows`` with ``matches``, the ids of the groups whose columns are all greater than zero. Stateless: batch and stream alike."""
    numbers = set(numeric_columns(flows))
    hit = lambda items: reduce(lambda a, b: a & b, [(positive(col(c)) == 1) if c in numbers else F.lit(False) for c in items], F.lit(True))
    return flows.withColumn("matches", F.array_compact(F.array(*[F.when(hit(items), F.lit(g)) for g, items in groups])))


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, keys..., n): rows per window of event time; rows later than the watermark are left out of a stream."""
    kept = events.withWatermark(time, late) if events.isStreaming else events
    return kept.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):  # noqa: ANN201
    """Write what is available now as Parquet, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
