"""Fresh paths in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset a temporary folder takes its place, in local mode only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it is computed once and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_pieces(df: DataFrame, time: str, pieces: int) -> list[DataFrame]:
    """``df`` cut into ranges of ``time``, in order; rows without a time are in the first. Some may be empty."""
    cuts = df.agg(F.percentile_approx(time, [i / pieces for i in range(1, pieces)], 1000).alias("c")).first()["c"] or [] if pieces > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    out = []
    for low, high in zip(edges, edges[1:]):
        part = df if low is None else df.where(F.col(time) > low)
        out.append(part if high is None else part.where((F.col(time) <= high) | F.col(time).isNull() if low is None else F.col(time) <= high))
    return out + [df.where("false")] * (pieces - len(out))
