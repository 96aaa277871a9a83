"""Exports: chunked clouds, logs by topic, final maps, text logs. Spark's writers and commit protocol do the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators import metrics


def write_chunks(points: DataFrame, path: str, size: int, keys: list[str], order: list[str]) -> None:
    """Clouds in folders by recording and chunk; a chunk holds ``size`` points, the last one what is left."""
    chunked = metrics.chunk_ids(points, size, keys, order)
    chunked.repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk", *order).write.mode("overwrite").partitionBy(*keys, "chunk").option("maxRecordsPerFile", size).parquet(path)


def write_topics(rows: DataFrame, path: str, topics: list[str], time: str = "time_ns") -> None:
    """One dataset a topic, by recording, in order of time inside a file."""
    for topic in topics:
        own = rows.where(F.col("topic") == topic).drop("topic")
        own.repartition("recording_id").sortWithinPartitions("recording_id", time).write.mode("overwrite").partitionBy("recording_id").parquet(f"{path}/{topic.strip('/').replace('/', '_')}")


def write_map(voxels: DataFrame, path: str) -> None:
    """The final map; readers see the old one or the new one, as the job's commit moves all files."""
    voxels.write.mode("overwrite").parquet(path)


def write_text_log(rows: DataFrame, path: str, event: str, columns: list[str]) -> None:
    """A log of ``key=value`` lines, which functions.text.log_fields reads back."""
    parts = [F.lit(f"event={event}"), *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns)]
    rows.select(F.concat_ws(" ", *parts).alias("value")).write.mode("overwrite").text(path)


def write_trajectory(poses: DataFrame, path: str, order: str = "time_ns") -> None:
    """Poses as CSV with a header, in order of time inside a recording's file."""
    poses.repartition("recording_id").sortWithinPartitions("recording_id", order).write.mode("overwrite").option("header", True).csv(path)
