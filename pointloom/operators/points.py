"""Point decoding, projections and filters. Column algebra and windows by frame; nothing else is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Returns in a raw point, and nanoseconds between raw points, by packet data type (fixed values of the format).
RETURNS = {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 7: 3, 8: 3}
INTERVAL_NS = {0: 10_000, 1: 10_000}
OTHER_INTERVAL_NS = 4_166
IMU_TYPE = 6
U32 = (1 << 32) - 1


def by_type(table: dict[int, int], data_type: Column, otherwise: int | None = None) -> Column:
    """A lookup in a table of a few fixed entries."""
    found = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), data_type)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def split_returns(returns: DataFrame) -> DataFrame:
    """Dual and triple returns as points of their own: raw_index and return_no of each (packets, idx)."""
    known = returns.withColumn("returns", by_type(RETURNS, F.col("data_type"))).where(F.col("returns").isNotNull())
    return known.select("*", F.expr("idx div returns").cast("int").alias("raw_index"), (F.col("idx") % F.col("returns")).cast("int").alias("return_no")).drop("returns")


def metres(mm: Column) -> Column:
    return mm / 1000.0


def from_spherical(depth_mm: Column, theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    """Cartesian metres from millimetres and hundredths of a degree; theta is measured from the z axis."""
    r, t, p = depth_mm / 1000.0, F.radians(theta / 100.0), F.radians(phi / 100.0)
    return r * F.sin(t) * F.cos(p), r * F.sin(t) * F.sin(p), r * F.cos(t)


def offset_ns(packet_ns: Column, raw_index: Column, data_type: Column, frame_ns: Column) -> Column:
    """Nanoseconds from the frame's start, held in an unsigned 32-bit range."""
    interval = by_type(INTERVAL_NS, data_type, OTHER_INTERVAL_NS).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(U32).cast("bigint"), packet_ns + raw_index * interval - frame_ns))


def good_line_tag(line: Column, tag: Column, scan_lines: int) -> Column:
    return (line < scan_lines) & tag.bitwiseAND(0x30).isin(0x00, 0x10)


def beyond_blind(x: Column, y: Column, z: Column, blind: float) -> Column:
    return x * x + y * y + z * z > blind * blind


def usable(*values: Column, most: float = 1e6) -> Column:
    """Finite and at most ``most`` in size."""
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= most)
    return out


def in_box(x: Column, y: Column, z: Column, low: tuple, high: tuple) -> Column:
    """Half open on each axis."""
    out = F.lit(True)
    for c, a, b in zip((x, y, z), low, high, strict=True):
        out = out & (c >= a) & (c < b)
    return out


def mapped_fields(points: DataFrame) -> DataFrame:
    """reflectivity to intensity (100 where absent), nanoseconds to milliseconds."""
    return points.withColumn("intensity", F.coalesce(F.col("reflectivity").cast("double"), F.lit(100.0))).withColumn("offset_ms", F.col("offset_ns") / 1e6)


def cleaned(points: DataFrame, scan_lines: int = 6, stride: int = 1, blind: float = 4.0, keys: tuple = ("frame_id",)) -> DataFrame:
    """Points that pass line, tag, stride, duplicate and blind-zone rules, in one window by frame.

    The first point of a frame is never used. The stride counts points with a good line and tag, before
    the modulo. A point repeats if no axis differs by more than 1e-7 from the slot before it, and that
    slot holds zeros unless its own point was written.
    """
    scan = Window.partitionBy(*keys).orderBy("idx")
    good = (F.col("idx") >= 1) & good_line_tag(F.col("line"), F.col("tag"), scan_lines)
    counted = points.withColumn("__n", F.sum(good.cast("int")).over(scan.rowsBetween(Window.unboundedPreceding, 0)))
    written = counted.withColumn("__written", good & (F.col("__n") % stride == 0))
    slots = written.select("*", *(F.lag(F.when(F.col("__written"), F.col(c)).otherwise(0.0), 1, 0.0).over(scan).alias(f"__{c}") for c in "xyz"))
    fresh = F.lit(False)
    for c in "xyz":
        fresh = fresh | (F.abs(F.col(c) - F.col(f"__{c}")) > 1e-7)
    kept = slots.where(F.col("__written") & fresh & beyond_blind(F.col("x"), F.col("y"), F.col("z"), blind))
    return kept.drop("__n", "__written", "__x", "__y", "__z")


def strided(points: DataFrame, stride: int, scan_lines: int = 6) -> DataFrame:
    """Every ``stride``-th point with a good line and tag, from the second of a frame on."""
    scan = Window.partitionBy("frame_id").orderBy("idx")
    good = (F.col("idx") >= 1) & good_line_tag(F.col("line"), F.col("tag"), scan_lines)
    return points.withColumn("__n", F.sum(good.cast("int")).over(scan)).where(good & (F.col("__n") % stride == 0)).drop("__n")


def without_repeats(points: DataFrame, scan_lines: int = 6) -> DataFrame:
    """Points with a good line and tag that differ from the slot before them."""
    return cleaned(points, scan_lines, 1, 0.0)


def capped(points: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """At most ``most`` points of a frame, in a given order; all of them if ``most`` is 0 or less."""
    if most <= 0:
        return points
    return points.withColumn("__n", F.row_number().over(Window.partitionBy("frame_id").orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def frame_gates(all_frames: DataFrame, points: DataFrame, least: int = 5) -> DataFrame:
    """(frame_id, n_points, status): why a frame is left out, or ``ok``."""
    counts = points.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    status = F.when(n == 0, "empty").when(n < least, "too_few_points").otherwise("ok")
    return all_frames.select("frame_id").distinct().join(counts, "frame_id", "left").select("frame_id", n.alias("n_points"), status.alias("status"))


def quality_counters(packets: DataFrame) -> DataFrame:
    """Unsupported and truncated packets, and whether points or inertial samples were seen. ``packets(data_type, n_returns)``."""
    known = F.col("data_type").isin(*RETURNS)
    full = by_type(RETURNS, F.col("data_type"), 1)
    return packets.agg(
        F.count_if(~known & (F.col("data_type") != IMU_TYPE)).alias("unsupported"), F.count_if(known & (F.col("n_returns") % full != 0)).alias("truncated"),
        F.bool_or(known).alias("seen_points"), F.bool_or(F.col("data_type") == IMU_TYPE).alias("seen_imu"),
    )
