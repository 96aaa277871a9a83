"""Rows as messages of a feed, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VECTOR = "struct<x:double,y:double,z:double>"
IMU_JSON = f"struct<timestamp:struct<sec:bigint,nsec:bigint>,frame_id:string,angular_velocity:{_VECTOR},linear_acceleration:{_VECTOR}>"


def _vector(columns: tuple) -> Column:
    return F.struct(*(F.col(c).alias(a) for c, a in zip(columns, "xyz", strict=True)))


def imu_json(ts_us: Column, frame_id: str, gyro: tuple | None = None, acc: tuple | None = None) -> Column:
    """An inertial sample as JSON of the fixed form; a vector that is absent is left out."""
    parts = [F.struct(F.floor(ts_us / 1_000_000).cast("bigint").alias("sec"), ((ts_us % 1_000_000) * 1000).cast("bigint").alias("nsec")).alias("timestamp"), F.lit(frame_id).alias("frame_id")]
    if gyro:
        parts.append(_vector(gyro).alias("angular_velocity"))
    if acc:
        parts.append(_vector(acc).alias("linear_acceleration"))
    return F.to_json(F.struct(*parts))


def parsed_imu(json: Column) -> Column:
    return F.from_json(json, IMU_JSON)
