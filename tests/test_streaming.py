"""Sinks that repeat a batch, state across batches, and rows that come late."""

from pyspark.sql import functions as F

from pointloom.operators import sync
from pointloom.sources.scratch import in_pieces, shared_path
from pointloom.streaming import feeds, stateful


def test_repeated_batch_is_written_once(spark):
    path = shared_path(spark, "sink")
    write = feeds.batch_sink(path)
    rows = spark.range(5)
    write(rows, 0)
    write(rows, 0)  # the retry of a failed delivery
    write(rows, 1)
    assert spark.read.parquet(path).count() == 10


def test_change_feed_keeps_the_newest(spark):
    path = shared_path(spark, "feed")
    rows = spark.createDataFrame([(0, 0, 0, 1, 5), (0, 0, 0, 3, 7), (0, 0, 0, 2, 6), (1, 0, 0, 1, 1)], "tx int, ty int, tz int, version long, n long")
    feeds.change_feed(path)(rows, 0)
    assert sorted((r.tx, r.version, r.n) for r in spark.read.parquet(path).collect()) == [(0, 3, 7), (1, 1, 1)]


def test_pairs_across_batches_equal_the_batch_join(spark):
    frames = spark.createDataFrame([(0, 1, 0, 10), (0, 2, 12, 40), (0, 3, 45, 200), (1, 4, 5, 8), (0, 5, 50, 60)], "device long, frame_id long, beg_us long, end_us long")
    imu = spark.createDataFrame([(d, 10 * d + k, k * 7, 0.0) for d in (0, 1) for k in range(10)], "device long, seq long, ts_us long, ax double")
    both = frames.select("device", F.lit("frame").alias("kind"), F.col("frame_id").alias("id"), "beg_us", "end_us").unionByName(
        imu.select("device", F.lit("imu").alias("kind"), F.col("seq").alias("id"), F.col("ts_us").alias("beg_us"), F.col("ts_us").alias("end_us"))
    )
    for pieces in (1, 4):
        path, schema = feeds.fed([(both, "beg_us")], stateful.interval_pairs, pieces)
        got = feeds.results(spark, path, schema).select("device", "frame_id", "seq").collect()
        want = sync.interval_join(frames, imu).select("device", "frame_id", "seq").collect()
        assert sorted(got) == sorted(want), pieces


def test_resync_and_latest(spark):
    path = shared_path(spark, "latest")
    rows = spark.createDataFrame([("pose", 1, "a"), ("pose", 2, "b"), ("path", 5, "c")], "channel string, t long, v string")
    feeds.latest_wins(path, ["channel"], "t")(rows, 0)
    assert sorted((r.channel, r.v) for r in spark.read.parquet(path).collect()) == [("path", "c"), ("pose", "b")]


def test_pieces_hold_all_rows_in_order(spark):
    rows = spark.createDataFrame([(i, i * 7 % 50 if i % 9 else None) for i in range(200)], "id long, t long").repartition(5)
    parts = [[(r.id, r.t) for r in p.collect()] for p in in_pieces(rows, "t", 4)]
    assert sorted(x[0] for p in parts for x in p) == list(range(200)) and all(t is not None for p in parts[1:] for _, t in p)
    known = [[t for _, t in p if t is not None] for p in parts]
    assert all(max(a) < min(b) for a, b in zip(known, known[1:]))
    assert [p.count() for p in in_pieces(rows.where("id < 0"), "t", 3)] == [0, 0, 0]


def test_a_silent_device_ends(spark):
    """Frames that were never covered come out, with the reason, once their device has been silent for the time set."""
    import time

    folder, path = shared_path(spark, "idle"), shared_path(spark, "idle-out")
    rows = [(0, "frame", 1, 0, 10), (0, "imu", 5, 4, 4), (1, "frame", 2, 0, 10), (2, "frame", 3, 0, 10), (2, "imu", 6, 3, 3), (2, "imu", 7, 12, 12)]
    events = spark.createDataFrame(rows, "device long, kind string, id long, beg_us long, end_us long")
    events.write.parquet(folder)
    stream = stateful.interval_pairs(feeds.packets_in(spark, folder, events.schema), idle_ms=500)
    query = stream.writeStream.foreachBatch(feeds.batch_sink(path)).option("checkpointLocation", shared_path(spark, "idle-state")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):  # a device's time runs out in some later batch
            time.sleep(0.5)
            got = sorted((r.device, r.frame_id, r.seq, r.reason or "") for r in feeds.results(spark, path, stream.schema).collect()) if query.lastProgress else []
            if len(got) == 3:
                break
    finally:
        query.stop()
    assert got == [(0, 1, None, "no_final_imu_coverage"), (1, 2, None, "no_final_imu"), (2, 3, 6, "")]


def test_dropped_samples_equal_the_batch_walk(spark, small):
    from pointloom.plans.streams import _arrivals, t5_dropped_samples

    rows = lambda df: sorted(str(r) for r in df.select("device", "frame_id", "seq", "ts_us", "reason").collect())
    got = t5_dropped_samples(spark, small)
    assert rows(got) == rows(sync.buffered_pairs(_arrivals(spark, small)))
    assert got.where("reason = 'clock_back'").count() > 0 and got.where("reason IS NULL").count() > 0


def test_buffer_drops():
    b = sync.SampleBuffer(most=2)
    assert b.push("imu", 1, 10, 10) == [] and b.push("imu", 2, 20, 20) == []
    assert b.push("imu", 3, 30, 30) == [(None, 1, 10, "full")]
    assert b.push("imu", 4, 5, 5) == [(None, 2, 20, "clock_back"), (None, 3, 30, "clock_back")]
    assert b.push("frame", 9, 0, 6) == [] and b.push("imu", 5, 7, 7) == [(9, 4, 5, None)]


def test_a_failed_delivery_is_repeated_once(spark):
    """A sink that fails half-way: the batch stays pending, and the next run of the query delivers it whole, once."""
    import pytest

    folder, path, state = (shared_path(spark, n) for n in ("retry", "retry-out", "retry-state"))
    spark.range(20).write.parquet(folder)
    tries = []

    def flaky(out):
        write = feeds.batch_sink(out)

        def sink(batch, batch_id):
            tries.append(batch_id)
            write(batch.where("id < 5") if len(tries) == 1 else batch, batch_id)
            if len(tries) == 1:
                raise IOError("the receiver went away")

        return sink

    stream = lambda: feeds.packets_in(spark, folder, spark.range(0).schema)
    with pytest.raises(Exception, match="went away"):
        feeds.run_to_end(stream(), flaky, path=path, state=state)
    feeds.run_to_end(stream(), flaky, path=path, state=state)
    assert tries == [0, 0] and sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(20))


def test_path_feed(spark):
    path = shared_path(spark, "path")
    write = feeds.kept_path(path, ["device"], ["t"], most=3)
    rows = lambda *ts: spark.createDataFrame([(0, t) for t in ts], "device long, t long")
    write(rows(1, 2), 0)
    write(rows(3, 4), 1)
    write(rows(3, 4), 1)  # repeated
    assert sorted(r.t for r in spark.read.parquet(f"{path}/batch=1").collect()) == [2, 3, 4]


def test_current_cloud_is_the_newest_frame(spark):
    path = shared_path(spark, "current")
    rows = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (0, 2, 1), (1, 1, 5), (None, 3, 0)], "map_id long, frame_id long, idx long")
    write = feeds.current_clouds(path, ["map_id"], "frame_id")
    write(rows, 0)
    write(rows, 0)  # repeated
    write(rows.limit(0), 1)
    assert sorted((r.map_id, r.frame_id, r.idx) for r in spark.read.parquet(path).collect()) == [(0, 2, 0), (0, 2, 1), (1, 1, 5)]  # points of no map are no map's cloud


def test_map_feed_view_at_every_batch(spark):
    """Whole maps and deltas give the same map at each batch, also where a batch is repeated after later ones were not."""
    path, keys, order = shared_path(spark, "mapfeed"), ["v"], ["version"]
    batches = [[(1, 1, "a"), (2, 1, "b")], [(2, 2, "c")], [], [(3, 3, "d"), (1, 3, "e")], [(3, 4, "f")]]
    frames = [spark.createDataFrame(b, "v long, version long, x string") for b in batches]
    write, state = feeds.map_feed(path, keys, order, every=2), {}
    for n, (rows, frame) in enumerate(zip(batches, frames, strict=True)):
        write(frame, n)
        write(frame, n)
        state |= {v: (version, x) for v, version, x in rows}
        view = feeds.map_view(spark, path, frame.schema, keys, order, 2, n)
        assert {r.v: (r.version, r.x) for r in view.collect()} == state, n
    whole = spark.read.schema(frames[0].schema).parquet(f"{path}/map/batch=3")
    assert sorted((r.v, r.x) for r in whole.collect()) == [(1, "e"), (2, "c"), (3, "d")]


def test_bounded_join_meets_by_bucket_and_loses_no_pair(spark):
    """Frames of up to the longest length, at bucket edges, overlapping and empty: the pairs of all rows, by an equi-join on buckets."""
    frames = [(f % 2, f, (f * 37) % 900, (f * 37) % 900 + (f * 13) % 121) for f in range(60)] + [(0, 100, 60, 120), (0, 101, 120, 120), (0, 102, 130, 90), (1, 103, 0, 400)]
    imu = [(s % 2, s, s * 3) for s in range(330)]
    f = spark.createDataFrame(frames, "device long, frame_id long, b long, e long").select("device", "frame_id", F.timestamp_seconds("b").alias("beg"), F.timestamp_seconds("e").alias("end"))
    s = spark.createDataFrame(imu, "device long, seq long, t long").select("device", "seq", F.timestamp_seconds("t").alias("ts"))
    joined = feeds.bounded_interval_join(f, s, "2 minutes", bucket_us=60_000_000)
    want = sorted((d, n, q) for d, n, b, e in frames for d2, q, t in imu if d == d2 and max(b, e - 120) < t <= e)
    assert sorted((r.device, r.frame_id, r.seq) for r in joined.collect()) == want and len(want) > 500
    keys = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "f_bucket" in keys


def test_a_busy_device_takes_time_by_its_rows(spark):
    """300,000 frames and samples of one device in one batch: each sample once, without copies of all that waits a frame."""
    import time

    n = 300_000
    both = spark.range(2 * n).select(
        F.lit(0).cast("long").alias("device"), F.when(F.col("id") < n, "frame").otherwise("imu").alias("kind"), (F.col("id") % n).alias("id"), (F.col("id") % n * 10 + F.when(F.col("id") < n, 0).otherwise(5)).alias("beg_us")
    ).withColumn("end_us", F.when(F.col("kind") == "frame", F.col("beg_us") + 10).otherwise(F.col("beg_us")))
    began = time.time()
    path, schema = feeds.fed([(both, "beg_us")], stateful.interval_pairs, 1)
    got = feeds.results(spark, path, schema)
    assert got.agg(F.count(F.lit(1)), F.sum((F.col("seq") == F.col("frame_id")).cast("int"))).first() == (n - 1, n - 1)
    assert time.time() - began < 40
