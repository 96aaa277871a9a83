"""Streams in and out: file streams of decoded packets, idempotent batch sinks, change feeds, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pointloom.operators import tiles
from pointloom.sources.scratch import in_pieces, shared_path


def packets_in(spark: SparkSession, path: str, schema: StructType, devices: list | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of decoded rows from files as they come, of given devices; files a batch may be bounded."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
    return rows if devices is None else rows.where(F.col("device").isin(*devices))


def batch_sink(path: str, change: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch to its own folder, overwriting what a failed attempt left:
    at-least-once delivery with a batch key is exactly once for a reader."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def change_feed(path: str) -> Callable[[DataFrame, int], None]:
    """Sink of tile changes: of a batch's updates of one tile the newest goes out (T8), live ones and deletions alike."""

    def newest(batch: DataFrame) -> DataFrame:
        return batch.groupBy(*tiles.TILE).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in tiles.TILE]), "version").alias("u")).select(*tiles.TILE, "u.*")

    return batch_sink(path, newest)


def latest_wins(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps each channel's newest row of a batch."""

    def newest(batch: DataFrame) -> DataFrame:
        return batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("u")).select(*keys, "u.*")

    return batch_sink(path, newest)


def kept_path(path: str, keys: list[str], order: list[str], most: int = 500) -> Callable[[DataFrame, int], None]:
    """Sink of a path: each batch publishes the newest ``most`` poses of each key, of the batch and of what was published
    before. The state is what the sink wrote last; a repeated batch starts from the one before it again."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id:
            rows = rows.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={batch_id - 1}"))
        newest = rows.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= most).drop("__n")
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current_clouds(path: str, keys: list[str], frame: str) -> Callable[[DataFrame, int], None]:
    """Sink of the current cloud: of each batch all points of each key's newest frame. Newest frames are one row a key; the
    points stay where they are, or meet them by (key, frame)."""

    def newest(batch: DataFrame) -> DataFrame:
        return batch.join(batch.groupBy(*keys).agg(F.max(frame).alias(frame)), [*keys, frame], "left_semi")

    return batch_sink(path, newest)


def _newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("u")).select(*keys, "u.*")


def map_feed(path: str, keys: list[str], order: list[str], every: int = 8) -> Callable[[DataFrame, int], None]:
    """Sink of a map that changes, cells by ``keys``: what a batch touched goes out as ``delta/batch=N``; after each
    ``every``-th batch the whole map goes out as ``map/batch=N``, made of the whole map before it and the deltas since, of each cell the
    newest by ``order``. A repeated batch reads the same folders and overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/delta/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            before = _map_folders(path, every, batch_id - 1) + [f"{path}/delta/batch={batch_id}"]
            _newest(batch.sparkSession.read.schema(batch.schema).parquet(*before), keys, order).write.mode("overwrite").parquet(f"{path}/map/batch={batch_id}")

    return write


def _map_folders(path: str, every: int, at: int) -> list[str]:
    """The last whole map that went out up to batch ``at``, and the deltas after it."""
    whole = (at + 1) // every * every - 1
    return [f"{path}/map/batch={whole}"] * (whole >= 0) + [f"{path}/delta/batch={k}" for k in range(whole + 1, at + 1)]


def map_view(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str], every: int, at: int) -> DataFrame:
    """The map after batch ``at`` as a consumer of :func:`map_feed` has it who came with the last whole map."""
    return _newest(spark.read.schema(schema).parquet(*_map_folders(path, every, at)), keys, order)


def odometry(poses: DataFrame) -> DataFrame:
    """Messages of ``poses(device, pose_id, ts_us, px, yaw)``, a pose and a transform from the map to the body each:
    seconds and nanoseconds, position, orientation as a quaternion about the vertical."""
    return poses.select(
        "device", "pose_id", F.floor(F.col("ts_us") / 1_000_000).cast("bigint").alias("sec"), (F.pmod("ts_us", F.lit(1_000_000)) * 1000).cast("bigint").alias("nsec"), F.lit("map").alias("frame"), F.lit("body").alias("child"),
        F.col("px").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(F.col("yaw") / 2).alias("qz"), F.cos(F.col("yaw") / 2).alias("qw"),
    )


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, name: str = "stream", mode: str = "append", path: str | None = None, state: str | None = None) -> str:
    """Runs all that is there through the stream in batches, and gives the folder of the results. With the ``state`` of an
    earlier run it goes on from where that one ended."""
    spark = stream.sparkSession
    path, state = path or shared_path(spark, name), state or shared_path(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    writer.foreachBatch(sink(path) if sink else batch_sink(path)).start().awaitTermination()
    return path


def fed(inputs: list[tuple[DataFrame, str]], build: Callable[..., DataFrame], pieces: int, sink: Callable[[str], Callable] | None = None, name: str = "stream", mode: str = "append", cut: Callable = in_pieces) -> tuple[str, StructType]:
    """Tables as streams: each of ``inputs`` (rows, time column) arrives in pieces by time, all in step; after each arrival
    the query ``build(*streams)`` is started again from its checkpoint and takes what is new as one batch. A piece has as
    many files as Spark makes of it; ``cut`` makes the pieces. Gives the folder of the results and their schema."""
    spark = inputs[0][0].sparkSession
    folders, path, state = [shared_path(spark, f"{name}-in") for _ in inputs], shared_path(spark, name), shared_path(spark, f"{name}-state")
    parts = [cut(rows, time, pieces) for rows, time in inputs]
    schema = None
    for k in range(pieces):
        for folder, own in zip(folders, parts, strict=True):
            own[k].write.mode("append").parquet(folder)
        stream = build(*(packets_in(spark, folder, rows.schema) for folder, (rows, _) in zip(folders, inputs, strict=True)))
        schema = stream.schema
        run_to_end(stream, sink, name, mode, path, state)
    return path, schema


def results(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All batches of a finished stream; no batch, no rows."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*wanted.fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)


def sessions(samples: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions of ``samples(device, ts, ts_us)`` by device: a gap ends one. They come out once the watermark has passed their
    end; state is the sessions that are open, rows later than ``delay`` are dropped."""
    return samples.withWatermark("ts", delay).groupBy("device", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"))


def run_observed(stream: DataFrame, sink: Callable[[DataFrame, int], None], state: str, name: str = "observed", mode: str = "append") -> dict[str, int]:
    """Runs all that is there through the stream, and gives what was counted on the way: the numbers of the stream's own
    ``observe(name, ...)``, added up over the batches, and ``late``, the rows that stateful operators
    dropped behind the watermark (an aggregation gets, and drops, a task's partial sums as one row). Nothing is read a second
    time for them; they come with each batch's progress."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    total: dict[str, int] = {"late": 0}
    for progress in query.recentProgress:
        total["late"] += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        for key, value in (progress.observedMetrics.get(name).asDict() if name in progress.observedMetrics else {}).items():
            total[key] = total.get(key, 0) + (value or 0)
    return total


def windowed_counts(samples: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts and means by device in tumbling event-time windows; rows later than ``delay`` are dropped."""
    return samples.withWatermark("ts", delay).groupBy("device", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("ax").alias("mean_ax"))


#: Width of the time buckets that the stream-stream join is dealt by.
BUCKET_US = 600_000_000


def bounded_interval_join(frames: DataFrame, imu: DataFrame, longest: str, delay: str = "10 minutes", bucket_us: int = BUCKET_US) -> DataFrame:
    """Stream-stream join of frames (device, frame_id, beg, end) and samples (device, seq, ts) by time bounds. State is bounded
    by both watermarks and the longest frame. It pairs overlapping frames alike; once-only pairs need stateful.interval_pairs.

    Frames are cut into the time buckets of the last ``longest`` before their end and joined by (device, bucket): a row
    meets what is held of its own bucket, not all of its device, and a busy device is many keys. A sample has one bucket, so
    no pair is made twice.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / bucket_us).cast("bigint")
    bound = F.expr(f"INTERVAL {longest}")
    f = frames.withWatermark("end", delay).select(F.col("device").alias("f_device"), "frame_id", "beg", "end").where("end > beg")
    f = f.withColumn("f_bucket", F.explode(F.sequence(bucket(F.greatest(F.col("beg"), F.col("end") - bound)), bucket(F.col("end")))))
    s = imu.withWatermark("ts", delay).withColumn("bucket", bucket(F.col("ts")))
    near = (F.col("f_device") == F.col("device")) & (F.col("f_bucket") == F.col("bucket")) & (F.col("ts") <= F.col("end")) & (F.col("ts") > F.col("beg")) & (F.col("ts") > F.col("end") - bound)
    return f.join(s, near).select("device", "frame_id", "seq", "ts")
