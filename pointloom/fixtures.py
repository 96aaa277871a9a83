"""Views over the driver's tables, for queries and their SQL twins. All are derived by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small cloud: 21 points in each of the frames that ``embeddings`` gives."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    i = F.col("idx")
    p = e.select("vec_id", "label", "v", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("idx"))
    return p.select(
        F.col("vec_id").alias("frame_id"), "idx", *((50 * F.col("v")[3 * i + k]).alias(c) for k, c in enumerate("xyz")),
        (F.col("label") * 25.0).alias("intensity"), ((F.col("vec_id") * 7 + i * 5) % 64).cast("int").alias("tag"), (i % 8).cast("int").alias("line"), (i * 0.5).cast("double").alias("offset_ms"),
    )


PTS = """pts AS (SELECT vec_id AS frame_id, i::INTEGER AS idx, 50 * embedding[3*i+1]::DOUBLE AS x, 50 * embedding[3*i+2]::DOUBLE AS y, 50 * embedding[3*i+3]::DOUBLE AS z,
    label * 25.0::DOUBLE AS intensity, ((vec_id * 7 + i * 5) % 64)::INTEGER AS tag, (i % 8)::INTEGER AS line, (i * 0.5)::DOUBLE AS offset_ms FROM embeddings, range(21) r(i))"""

def pts_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bench cloud, one point a row of ``lineitem``; ``ord`` is its number in the order of arrival: the day, the order
    and its line, then the part."""
    li = table(spark, sf_dir, "lineitem")
    day = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("bigint")
    arrival = ((day * (1 << 34) + F.col("l_orderkey")) * 8 + F.col("l_linenumber")) * (1 << 14) + F.col("l_partkey") % (1 << 14)
    return li.select(
        F.col("l_orderkey").alias("frame_id"), (F.col("l_quantity") - 25).alias("x"), ((F.col("l_extendedprice") - 52500) / 1000).alias("y"),
        F.round((F.col("l_discount") - 0.05) * 100, 6).alias("z"), F.round(F.col("l_tax") * 1000, 6).alias("intensity"), arrival.cast("bigint").alias("ord"),
    )


PTS_BIG = """pts_big AS (SELECT l_orderkey AS frame_id, l_quantity - 25 AS x, (l_extendedprice - 52500) / 1000 AS y, round((l_discount - 0.05) * 100, 6) AS z,
    round(l_tax * 1000, 6) AS intensity, ((date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::BIGINT * 17179869184 + l_orderkey) * 8 + l_linenumber) * 16384 + l_partkey % 16384 AS ord FROM lineitem)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return e.select(
        (F.col("user_id") % 4).alias("device"), F.col("event_id").alias("frame_id"), micros(F.col("ts")).alias("beg_us"),
        (micros(F.col("ts")) + F.round(F.col("value") * 100).cast("bigint") * 300000).alias("end_us"),
    )


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(~F.col("event_type").isin("view", "click"))
    return e.select((F.col("user_id") % 4).alias("device"), F.col("event_id").alias("seq"), micros(F.col("ts")).alias("ts_us"), F.col("value").alias("ax"))


FRAMES = """frames AS (SELECT user_id % 4 AS device, event_id AS frame_id, epoch_us(ts) AS beg_us, epoch_us(ts) + round(value * 100)::BIGINT * 300000 AS end_us
    FROM events WHERE event_type IN ('view', 'click'))"""
IMU = "imu AS (SELECT user_id % 4 AS device, event_id AS seq, epoch_us(ts) AS ts_us, value AS ax FROM events WHERE event_type NOT IN ('view', 'click'))"


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planar poses of a device in time: position along x, heading in radians."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select((F.col("user_id") % 4).alias("device"), F.col("event_id").alias("pose_id"), micros(F.col("ts")).alias("ts_us"), F.col("value").alias("px"), ((F.col("event_id") % 360) * (3.14159265358 / 180.0)).alias("yaw"))


POSES = """poses AS (SELECT user_id % 4 AS device, event_id AS pose_id, epoch_us(ts) AS ts_us, value AS px, (event_id % 360) * (3.14159265358 / 180.0)::DOUBLE AS yaw
    FROM events WHERE event_type = 'purchase')"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with their returns; data type 6 carries no points."""
    p = pts(spark, sf_dir)
    return p.select(
        F.col("frame_id").alias("packet_no"), (F.col("frame_id") % 9).cast("int").alias("data_type"), (F.col("frame_id") * 1000000).alias("ts_ns"), "idx",
        *(F.round(F.col(c) * 1000).cast("int").alias(f"{c}_mm") for c in "xyz"), (F.col("intensity") % 256).cast("int").alias("reflectivity"), "tag",
    )


PACKETS = f"""{PTS}, packets AS (SELECT frame_id AS packet_no, (frame_id % 9)::INTEGER AS data_type, frame_id * 1000000 AS ts_ns, idx, round(x * 1000)::INTEGER AS x_mm,
    round(y * 1000)::INTEGER AS y_mm, round(z * 1000)::INTEGER AS z_mm, (intensity::INTEGER % 256)::INTEGER AS reflectivity, tag FROM pts)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.format_string("event=%s frame=%d total_ms=%.2f points=%d state=%s", F.when(F.col("event_type") == "click", "map_update").otherwise("processed"), "event_id", "value", "user_id", "event_type")
    return e.select("event_id", line.alias("line"))
