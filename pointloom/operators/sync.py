"""Aligning frames, inertial samples, poses and messages in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators import scans
from pointloom.operators.walks import walked

#: Width of the time buckets that range joins are dealt by.
BUCKET_US = 3_600_000_000


def frame_ends(points: DataFrame, begin: str = "begin_s") -> DataFrame:
    """(frame_id, begin, end): the largest offset of a frame's points, 0 at least, after its begin."""
    return points.groupBy("frame_id", begin).agg((F.col(begin) + F.greatest(F.max("offset_ms"), F.lit(0.0)) / 1000.0).alias("end_s"))


def covered_frames(frames: DataFrame, imu: DataFrame) -> DataFrame:
    """Frames with their sample window (low_us, end_us] and status, in arrival order of a device.

    Frames are first in, first out: one that is not covered holds up all later ones, so a frame counts
    as covered if the running maximum of ends, its own included, is at or before the last sample.
    """
    order = Window.partitionBy("device").orderBy("beg_us", "frame_id")
    last = imu.groupBy("device").agg(F.max("ts_us").alias("last_us"))
    run = frames.withColumn("low_us", F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("high_us", F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    status = F.when(F.col("last_us").isNull(), "no_final_imu").when(F.col("high_us") > F.col("last_us"), "no_final_imu_coverage").otherwise("covered")
    return run.join(last, "device", "left").withColumn("status", status)


def interval_join(frames: DataFrame, imu: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """(device, frame_id, seq, ts_us): each sample once, with the covered frame whose window it falls in.

    The windows of a device don't overlap. They are cut into time buckets and joined by (device, bucket),
    so a busy device is spread over many keys; the exact bounds filter after that.
    """
    windows = covered_frames(frames, imu).where("status = 'covered'").select("device", "frame_id", F.coalesce("low_us", F.lit(-(1 << 62))).alias("low_us"), "end_us").where("end_us > low_us")
    first = imu.groupBy("device").agg(F.min("ts_us").alias("first_us"))
    bounded = windows.join(first, "device").withColumn("from_us", F.greatest("low_us", F.col("first_us") - 1))
    bucket = lambda c: F.floor(c / bucket_us).cast("bigint")
    dealt = bounded.where("end_us > from_us").withColumn("bucket", F.explode(F.sequence(bucket(F.col("from_us") + 1), bucket(F.col("end_us")))))
    samples = imu.withColumn("bucket", bucket(F.col("ts_us")))
    met = samples.join(dealt.select("device", "bucket", "frame_id", "low_us", "end_us"), ["device", "bucket"]).where("ts_us > low_us AND ts_us <= end_us")
    return met.select("device", "frame_id", "seq", "ts_us")


def tail_report(frames: DataFrame, imu: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(device, reason, frames): what is left when the input ends. ``sizes(frame_id, n_points)`` marks empty frames."""
    found = covered_frames(frames, imu)
    reason = F.col("status")
    if sizes is not None:
        found = found.join(sizes, "frame_id", "left")
        reason = F.when(F.coalesce("n_points", F.lit(0)) == 0, "empty_lidar_frame").otherwise(reason)
    reason = F.when(F.col("beg_us").isNull(), "missing_lidar_timestamp").otherwise(reason)
    return found.withColumn("reason", reason).where("reason <> 'covered'").groupBy("device", "reason").agg(F.count(F.lit(1)).alias("frames"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], strict: bool = True, bucket_us: int = BUCKET_US) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` whose time is before (or, not strict, at) its own.

    Both sides are cut into time buckets and sorted together by (keys, bucket), so a busy key is spread over many tasks
    and no row pairs are made. What a bucket starts with, the last row before it, comes from a running value over buckets
    (one row each). On equal times a strict match puts the left rows first, so that an equal row of the right does not count.
    """
    bucket = F.floor(F.col(time) / bucket_us).cast("bigint").alias("__bucket")
    found = F.struct(*values)
    kind = right.select(found.alias("x")).schema["x"].dataType
    own = [c for c in left.columns if c not in keys + [time]]
    row = F.struct(*own) if own else F.struct(F.lit(1).alias("__none"))
    row_kind = left.select(row.alias("x")).schema["x"].dataType
    lefts = left.select(*keys, bucket, F.col(time), F.lit(0 if strict else 1).alias("__side"), row.alias("__left"), F.lit(None).cast(kind).alias("__right"))
    rights = right.select(*keys, bucket, F.col(time), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(row_kind).alias("__left"), found.alias("__right"))
    ends = rights.groupBy(*keys, "__bucket").agg(F.max_by("__right", time).alias("__end"))
    known = ends.unionByName(lefts.select(*keys, "__bucket", F.lit(None).cast(kind).alias("__end")).distinct()).groupBy(*keys, "__bucket").agg(F.first("__end", ignorenulls=True).alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    opens = known.withColumn("__before", before).where(F.col("__before").isNotNull())
    carried = opens.select(*keys, "__bucket", F.lit(None).cast("bigint").alias(time), F.lit(-1).alias("__side"), F.lit(None).cast(row_kind).alias("__left"), F.col("__before").alias("__right"))
    order = Window.partitionBy(*keys, "__bucket").orderBy(F.asc_nulls_first(time), "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = lefts.unionByName(rights).unionByName(carried).withColumn("__found", F.last("__right", ignorenulls=True).over(order)).where(F.col("__left").isNotNull())
    return met.select(*keys, time, *(F.col(f"__left.{c}").alias(c) for c in own), *(F.col(f"__found.{v}").alias(v) for v in values))


def gap_frames(messages: DataFrame, gap_us: int, keys: list[str], time: str = "ts_us") -> DataFrame:
    """Messages with ``frame``: a new one begins where the gap to the message before is larger than ``gap_us``. One device's
    messages are as many tasks as they fill (a prefix scan)."""
    return scans.breaks(messages, keys, [time, "seq"], time, "frame", gap=gap_us)


def clock_epochs(samples: DataFrame, keys: list[str], arrival: str = "seq", time: str = "ts_us") -> DataFrame:
    """Samples with ``epoch``, which rises where a sample is older than the one that arrived before it (a prefix scan)."""
    return scans.breaks(samples, keys, [arrival], time, "epoch")


def by_sensor_time(messages: DataFrame, known_topics: list[str]) -> DataFrame:
    """Messages with ``place`` in order of sensor time; topics that are not known sort at time 0 (a prefix scan)."""
    time = F.when(F.col("topic").isin(*known_topics), F.col("sensor_us")).otherwise(0)
    return scans.row_numbers(messages.withColumn("order_us", time), ["recording_id"], ["order_us", "seq"], "place")


def best_topic(messages: DataFrame, ranked: list[str]) -> DataFrame:
    """Messages of each recording's first topic of ``ranked`` that it has."""
    rank = F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(ranked) for x in (t, i))), F.col("topic"))
    known = messages.withColumn("__rank", rank).where(F.col("__rank").isNotNull())
    chosen = known.groupBy("recording_id").agg(F.min("__rank").alias("__best"))
    return known.join(chosen, "recording_id").where(F.col("__rank") == F.col("__best")).drop("__rank", "__best")


def seek(messages: DataFrame, time: str, target: Column) -> DataFrame:
    """Messages from ``target`` on; from each recording's last one on where the target is beyond it."""
    last = messages.groupBy("recording_id").agg(F.max(time).alias("__last"))
    return messages.join(last, "recording_id").where(F.col(time) >= F.least(target, F.col("__last"))).drop("__last")


def recording_summary(messages: DataFrame, time: str = "sensor_us") -> DataFrame:
    return messages.groupBy("recording_id", "topic").agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("start_us"), F.max(time).alias("end_us"), ((F.max(time) - F.min(time)) / 1e6).alias("duration_s")
    )


class SampleBuffer:
    """What a device holds while frames wait for inertial samples: fed in order of arrival, it gives (frame_id, seq,
    ts_us, reason) rows. A sample used by a frame has no reason. A sample older than the one before it drops all that are
    held (``clock_back``); beyond ``most`` samples the oldest goes (``full``); both have no frame.
    """

    def __init__(self, samples: list | None = None, frames: list | None = None, high: int = -(1 << 62), last: int | None = None, most: int = 20_000):
        self.samples, self.frames, self.high, self.last, self.most = samples or [], frames or [], high, last, most

    def push(self, kind: str, id: int, beg_us: int, end_us: int) -> list[tuple]:
        out = []
        if kind == "frame":
            self.frames.append((id, end_us))
        else:
            if self.last is not None and beg_us < self.last:
                out += [(None, s, t, "clock_back") for s, t in self.samples]
                self.samples = []
            self.last = beg_us
            if len(self.samples) >= self.most:
                s, t = self.samples.pop(0)
                out.append((None, s, t, "full"))
            self.samples.append((id, beg_us))
        while self.frames and self.last is not None and max(self.high, self.frames[0][1]) <= self.last:
            frame, end = self.frames.pop(0)
            low, self.high = self.high, max(self.high, end)
            used = [x for x in self.samples if x[1] <= self.high]
            self.samples = self.samples[len(used) :]  # times rise since the clock last went back
            out += [(frame, s, t, None) for s, t in used if low < t <= end]
        return out


def buffered_pairs(arrivals: DataFrame) -> DataFrame:
    """(device, frame_id, seq, ts_us, reason) of ``arrivals(device, arrival, kind, id, beg_us, end_us)``: the pairs and the
    dropped samples of :class:`SampleBuffer`. Samples that are still held at the end are in no row."""
    step = lambda held, row: held.push(row["kind"], row["id"], row["beg_us"], row["end_us"])
    return walked(arrivals, ["device"], ["arrival"], SampleBuffer, step, "frame_id bigint, seq bigint, ts_us bigint, reason string")
