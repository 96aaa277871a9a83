"""Timing summaries, counters, chunking, path bounds, throttling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators import chains, scans
from pointloom.operators.walks import walked


def last_samples(samples: DataFrame, window: int, keys: list[str], order: str, value: str) -> DataFrame:
    """The last ``window`` samples of each key; negative and non-finite values don't count."""
    good = samples.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & (F.col(value) >= 0))
    return good.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("__n") <= window).drop("__n")


def timing_summary(samples: DataFrame, keys: list[str], order: str, value: str, window: int = 1024) -> DataFrame:
    """Samples in all and in the window, its average, and its 95th and 99th percentile by nearest rank."""
    good = samples.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & (F.col(value) >= 0))
    total = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    recent = last_samples(samples, window, keys, order, value)
    shares = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_window"), F.avg(value).alias("average"), *(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(n) for q, n in ((0.95, "p95"), (0.99, "p99"))))
    return total.join(shares, keys)


def channel_counters(records: DataFrame, keys: list[str], value: str, most: float) -> DataFrame:
    """Peak of a value, and how many records are over, overwritten or good by channel."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.max(value).alias("peak"), F.sum((F.col(value) > most).cast("bigint")).alias("over"), F.sum(F.when(F.col(value) <= most, F.col(value)).otherwise(0)).alias("accepted"))


def chunk_ids(rows: DataFrame, size: int, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``chunk``: a new one after every ``size`` rows; the last one may be shorter (a prefix scan)."""
    return scans.row_numbers(rows, keys, order, "__n").withColumn("chunk", F.floor((F.col("__n") - 1) / size).cast("bigint")).drop("__n")


def frame_chunks(frames: DataFrame, points: int, count: int, keys: list[str], order: str = "frame_id") -> DataFrame:
    """Frames ``(keys, order, n_points)`` with ``chunk``: it rotates once it has ``points`` points or ``count`` frames (0: no
    such bound). What a chunk holds restarts with it, so frames, one row each, are walked in order."""

    def step(held: dict, row: dict) -> tuple:
        chunk = held["chunk"]
        held["points"], held["frames"] = held["points"] + row["n_points"], held["frames"] + 1
        if (points > 0 and held["points"] >= points) or (count > 0 and held["frames"] >= count):
            held.update(chunk=chunk + 1, points=0, frames=0)
        return row[order], row["n_points"], chunk

    begin = lambda: {"chunk": 0, "points": 0, "frames": 0}
    kind = dict(frames.dtypes)[order]
    return walked(frames.select(*keys, order, F.col("n_points").cast("bigint").alias("n_points")), keys, [order], begin, step, f"{order} {kind}, n_points bigint, chunk bigint")


def chunk_index(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(time).alias("start_us"), F.max(time).alias("end_us"), F.count(F.lit(1)).alias("messages"))


def bounded_path(path: DataFrame, capacity: int, publish: int, keys: list[str], order: str) -> DataFrame:
    """Path points that are still held, with ``published`` for the last ``publish``.

    At capacity the oldest tenth goes before a point is added, so after n points the number held is
    ``n`` up to the capacity, then falls back by a tenth and grows again: a formula of n alone. Places come from a prefix
    scan, so one device's path is many tasks.
    """
    cut = max(1, capacity // 10)
    numbered = scans.row_numbers(path, keys, [order], "__n")
    total = path.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    n, back = F.col("__total"), F.col("__total") - F.col("__n") + 1
    held = F.when(n <= capacity, n).otherwise(capacity - cut + 1 + F.pmod(n - capacity - 1, F.lit(cut)))
    met = numbered.alias("p").join(total.alias("t"), [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    return met.where(back <= held).select("p.*", (back <= publish).alias("published")).drop("__n")


def throttled(messages: DataFrame, keys: list[str], time_us: str, hz: float) -> DataFrame:
    """Messages that a rate limit lets through: at least ``1 / hz`` after the last one let through. Time buckets work out what
    they do for any message before them, so a busy key is many tasks (:mod:`pointloom.operators.chains`)."""
    return chains.kept(messages.select(*keys, time_us, F.col("seq").cast("bigint").alias("seq")), keys, time_us, "seq", int(round(1e6 / hz)))


def accumulated_frames(packets: DataFrame, keys: list[str], most_s: float = 0.10, most_points: int = 20_000) -> DataFrame:
    """Packets ``(keys, ts_us, seq, n_points)`` with ``frame`` and its ``begin_us``: a frame closes when it is ``most_s`` long or
    has ``most_points`` points; the next packet opens the next one. A row is a packet, never a point."""

    def step(held: dict, row: dict) -> tuple:
        if held["begin"] is None:
            held.update(begin=row["ts_us"], points=0)
        held["points"] += row["n_points"]
        out = row["ts_us"], row["seq"], row["n_points"], held["frame"], held["begin"]
        if (row["ts_us"] - held["begin"]) / 1e6 >= most_s or held["points"] >= most_points:
            held.update(frame=held["frame"] + 1, begin=None)
        return out

    narrow = packets.select(*keys, *(F.col(c).cast("bigint").alias(c) for c in ("ts_us", "seq", "n_points")))
    begin = lambda: {"frame": 0, "begin": None, "points": 0}
    return walked(narrow, keys, ["ts_us", "seq"], begin, step, "ts_us bigint, seq bigint, n_points bigint, frame bigint, begin_us bigint")
