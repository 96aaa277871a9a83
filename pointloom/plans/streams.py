"""Streaming queries: run over the tables in several batches, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom import fixtures as fx
from pointloom.plans.alignment import _COVER
from pointloom.plans.cloud import _TILES, tiled
from pointloom.plans.features import _ROUND_TRIP, recorded_points, recorded_rows
from pointloom.plans.maps import _VERSIONS, _deltas
from pointloom.plans.registry import ORACLE_SQL, query, r, sql_r
from pointloom.sources import lvx, recordings
from pointloom.sources.scratch import shared_path
from pointloom.streaming import feeds, keyed, ledger, stateful

PIECES = 3


def _collected(inputs, build, sink=None, name="stream", mode="append"):
    """All batches that the streaming query ``build`` gives for tables (rows, time) that arrive in pieces."""
    path, schema = feeds.fed(inputs, build, PIECES, sink, name, mode)
    return feeds.results(inputs[0][0].sparkSession, path, schema)


@query(ORACLE_SQL["j1_interval_join"])
def t2_stream_interval_join(spark, d):
    frames = fx.frames(spark, d).select("device", F.lit("frame").alias("kind"), F.col("frame_id").alias("id"), "beg_us", "end_us")
    imu = fx.imu(spark, d).select("device", F.lit("imu").alias("kind"), F.col("seq").alias("id"), F.col("ts_us").alias("beg_us"), F.col("ts_us").alias("end_us"))
    return _collected([(frames.unionByName(imu), "beg_us")], stateful.interval_pairs, name="t2").drop("batch")


@query(ORACLE_SQL["g4_throttle"])
def t4_stream_throttle(spark, d):
    rows = fx.imu(spark, d).select("device", "seq", "ts_us")
    return _collected([(rows, "ts_us")], lambda s: stateful.throttle(s, 1_800_000_000), name="t4").select("device", "seq")


@query(ORACLE_SQL["g3_frame_accumulation"])
def t3_stream_frames(spark, d):
    packets = fx.imu(spark, d).select("device", "seq", "ts_us", (F.col("seq") % 7).alias("n_points"))
    return _collected([(packets, "ts_us")], lambda s: stateful.count_or_time_frames(s, 3600, 20), name="t3").drop("batch")


@query(ORACLE_SQL["w10_clock_epochs"])
def t5_stream_epochs(spark, d):
    late = fx.imu(spark, d).select("device", "seq", (F.col("ts_us") - F.when(F.col("seq") % 97 == 0, 1_000_000_000).otherwise(0)).alias("ts_us"))
    return _collected([(late, "seq")], stateful.clock_epochs, name="t5").drop("batch")


@query(f"""WITH {_TILES}, {_VERSIONS.format(rows='tiled')}, c AS (SELECT tx, ty, tz, count(DISTINCT (vx, vy, vz)) AS n_voxels, count(*)::BIGINT AS n_points FROM tiled GROUP BY tx, ty, tz),
m AS (SELECT tx, ty, tz, max(version) AS version FROM ver GROUP BY tx, ty, tz), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz, vx, vy, vz ORDER BY frame_id DESC, idx DESC) AS k FROM tiled) WHERE k = 1)
SELECT tx, ty, tz, n_voxels, n_points, version, {sql_r('(SELECT sum(x) FROM l WHERE l.tx = c.tx AND l.ty = c.ty AND l.tz = c.tz)')} AS sum_x FROM c JOIN m USING (tx, ty, tz)""")
def t7_stream_tile_map(spark, d):
    """The map after the last batch, from the voxels that the batches touched: of each the newest."""
    points = tiled(spark, d).select("tx", "ty", "tz", "vx", "vy", "vz", "frame_id", "idx", "x", "y", "z", "intensity")
    touched = _collected([(points, "frame_id")], keyed.tile_cells, name="t7", mode="update")
    cells = touched.groupBy("tx", "ty", "tz", "vx", "vy", "vz").agg(F.max_by(F.struct("version", "n_points", "n_voxels", "x"), "version").alias("u"))
    return cells.groupBy("tx", "ty", "tz").agg(F.max("u.n_voxels").alias("n_voxels"), F.max("u.n_points").alias("n_points"), F.max("u.version").alias("version"), r(F.sum("u.x")).alias("sum_x"))


@query(f"""WITH {fx.IMU}, w AS (SELECT device, ts_us // 3600000000 AS h, count(*) AS n, avg(ax) AS m FROM imu GROUP BY 1, 2), l AS (SELECT max(ts_us) // 3600000000 AS last_h FROM imu)
SELECT device, (h * 3600000000)::BIGINT AS start_us, n, {sql_r('m')} AS mean_ax FROM w, l WHERE h < last_h""")
def t1_watermark_windows(spark, d):
    """Hourly windows that the watermark has closed: all but those of the last hour."""
    rows = fx.imu(spark, d).select("device", "ax", "ts_us", F.timestamp_micros("ts_us").alias("ts"))
    found = _collected([(rows, "ts_us")], lambda s: feeds.windowed_counts(s, "1 hour", "0 seconds"), name="t1")
    return found.select("device", F.unix_micros("w.start").alias("start_us"), "n", r(F.col("mean_ax")).alias("mean_ax"))


@query(f"WITH {fx.IMU} SELECT device, seq, {sql_r('ax')} AS ax FROM imu WHERE device IN (1, 3)")
def s7_device_stream(spark, d):
    return _collected([(fx.imu(spark, d), "ts_us")], lambda s: s.where(F.col("device").isin(1, 3)), name="s7").select("device", "seq", r(F.col("ax")).alias("ax"))


@query(f"WITH {_COVER} SELECT device, frame_id, seq FROM frames f JOIN imu i USING (device) WHERE i.ts_us > f.beg_us AND i.ts_us <= f.end_us AND f.end_us - f.beg_us < 7200000000")
def t2_bounded_stream_join(spark, d):
    """The plain stream-stream join, of frames of under two hours; all state is bounded by the watermarks."""
    frames = fx.frames(spark, d).where("end_us - beg_us < 7200000000").select("device", "frame_id", F.timestamp_micros("beg_us").alias("beg"), F.timestamp_micros("end_us").alias("end"), "beg_us")
    imu = fx.imu(spark, d).select("device", "seq", F.timestamp_micros("ts_us").alias("ts"), "ts_us")
    build = lambda f, s: feeds.bounded_interval_join(f.drop("beg_us"), s.drop("ts_us"), "2 hours", "30 days")
    return _collected([(frames, "beg_us"), (imu, "ts_us")], build, name="t2").select("device", "frame_id", "seq")


@query(f"WITH {fx.POSES}, n AS (SELECT device, count(*) AS n, arg_max(pose_id, ts_us) AS pose_id FROM poses GROUP BY device) SELECT device, pose_id FROM n")
def s14_latest_pose_feed(spark, d):
    """A channel that keeps the newest pose of each batch; the last batch's is the newest of all."""
    rows = fx.poses(spark, d).select("device", "pose_id", "ts_us", "px")
    found = _collected([(rows, "ts_us")], lambda s: s, lambda path: feeds.latest_wins(path, ["device"], "ts_us"), "s14")
    return found.groupBy("device").agg(F.max_by("pose_id", "ts_us").alias("pose_id"))


@query(f"WITH {_TILES}, {_VERSIONS.format(rows='tiled')}, m AS (SELECT tx, ty, tz, max(version) AS version FROM ver GROUP BY tx, ty, tz) SELECT tx, ty, tz, version, 'tile/' || tx || '/' || ty || '/' || tz AS id FROM m")
def s12_tile_change_feed(spark, d):
    """Batches of tile changes as a feed of entities; the last version of each tile is the map's."""
    from pointloom.functions import text as tx

    points = tiled(spark, d).select("tx", "ty", "tz", "vx", "vy", "vz", "frame_id", "idx", "x", "y", "z", "intensity")
    feed = _collected([(points, "frame_id")], stateful.tile_changes, feeds.change_feed, "s12")
    return feed.groupBy("tx", "ty", "tz").agg(F.max("version").alias("version")).withColumn("id", tx.tile_id(F.col("tx"), F.col("ty"), F.col("tz")))


@query(f"WITH {fx.POSES} SELECT device, pose_id, ts_us // 1000000 AS sec, ts_us % 1000000 * 1000 AS nsec, 'map' AS frame, 'body' AS child, {sql_r('px')} AS x, {sql_r('sin(yaw / 2)')} AS qz, {sql_r('cos(yaw / 2)')} AS qw FROM poses")
def s14_odometry_feed(spark, d):
    """Each pose as an odometry message and transform."""
    rows = fx.poses(spark, d).select("device", "pose_id", "ts_us", "px", "yaw")
    found = _collected([(rows, "ts_us")], feeds.odometry, name="s14o")
    return found.select("device", "pose_id", "sec", "nsec", "frame", "child", *(r(F.col(c)).alias(c) for c in ("x", "qz", "qw")))


@query(f"WITH {fx.POSES}, n AS (SELECT device, pose_id, ts_us, row_number() OVER (PARTITION BY device ORDER BY ts_us DESC, pose_id DESC) AS k FROM poses) SELECT device, pose_id, ts_us FROM n WHERE k <= 500")
def s14_path_feed(spark, d):
    """The path as published last: the newest 500 poses of each device."""
    rows = fx.poses(spark, d).select("device", "pose_id", "ts_us")
    found = _collected([(rows, "ts_us")], lambda s: s, lambda path: feeds.kept_path(path, ["device"], ["ts_us", "pose_id"]), "s14p")
    return found.where(F.col("batch") == PIECES - 1).drop("batch")


@query(f"WITH {fx.PTS}, n AS (SELECT *, frame_id % 4 AS map_id, max(frame_id) OVER (PARTITION BY frame_id % 4) AS newest FROM pts) SELECT map_id, frame_id, idx, {sql_r('x')} AS x FROM n WHERE frame_id = newest")
def s14_current_cloud_feed(spark, d):
    """The cloud as published last: all points of each map's newest frame."""
    rows = fx.pts(spark, d).select((F.col("frame_id") % 4).alias("map_id"), "frame_id", "idx", "x")
    found = _collected([(rows, "frame_id")], lambda s: s, lambda path: feeds.current_clouds(path, ["map_id"], "frame_id"), "s14c")
    newest = found.groupBy("map_id").agg(F.max("frame_id").alias("frame_id"))
    return found.join(newest, ["map_id", "frame_id"], "left_semi").select("map_id", "frame_id", "idx", r(F.col("x")).alias("x"))


_CELL, _CELL_ORDER, _EVERY = ["tx", "ty", "tz", "vx", "vy", "vz"], ["version", "n"], 2


def _map_feed(spark, d):
    """The tiled map's feed over three steps of frames, with a whole map after each second batch."""
    points = tiled(spark, d).select(*_CELL, "frame_id", "idx", "x", "y", "z", "intensity", F.least(F.expr("frame_id div 170"), F.lit(2)).alias("step"))
    by_step = lambda rows, time, n: [rows.where(F.col(time) == k) for k in range(n)]
    return feeds.fed([(points, "step")], lambda s: keyed.tile_cells(s.drop("step")), PIECES, lambda path: feeds.map_feed(path, _CELL, _CELL_ORDER, _EVERY), "s14m", "update", by_step)


@query(f"""WITH {_TILES}, s AS (SELECT *, least(frame_id // 170, 2)::INTEGER AS batch FROM tiled), k AS (SELECT *, row_number() OVER (PARTITION BY batch, tx, ty, tz, vx, vy, vz ORDER BY frame_id DESC, idx DESC) AS k FROM s)
SELECT batch, tx, ty, tz, vx, vy, vz, frame_id, idx, {sql_r('x')} AS x FROM k WHERE k = 1""")
def s14_map_delta_feed(spark, d):
    """What each batch changed of the map: the voxels that it touched, as they are after it."""
    path, schema = _map_feed(spark, d)
    return feeds.results(spark, f"{path}/delta", schema).select(F.col("batch").cast("int").alias("batch"), *_CELL, "frame_id", "idx", r(F.col("x")).alias("x"))


@query(f"""WITH {_TILES}, k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY tx, ty, tz, vx, vy, vz) AS n FROM tiled WINDOW w AS (PARTITION BY tx, ty, tz, vx, vy, vz ORDER BY frame_id DESC, idx DESC))
SELECT tx, ty, tz, vx, vy, vz, frame_id, idx, n, {sql_r('x')} AS x FROM k WHERE k = 1""")
def s14_full_map_feed(spark, d):
    """The map of a consumer who took the last whole map and the deltas after it."""
    path, schema = _map_feed(spark, d)
    last = feeds.results(spark, f"{path}/delta", schema).agg(F.max("batch")).first()[0]
    view = feeds.map_view(spark, path, schema, _CELL, _CELL_ORDER, _EVERY, last if last is not None else 0)
    return view.select(*_CELL, "frame_id", "idx", "n", r(F.col("x")).alias("x"))


@query()
def t5_dropped_samples(spark, d):
    """Pairs and dropped samples where clocks go back: against the batch walk in the tests."""
    rows = _arrivals(spark, d)
    return _collected([(rows, "arrival")], stateful.buffered_pairs, name="t5b").drop("batch")


def _arrivals(spark, d):
    """Frames and samples in one order of arrival; every 97th sample's clock is behind."""
    frames = fx.frames(spark, d).select("device", F.col("frame_id").alias("arrival"), F.lit("frame").alias("kind"), F.col("frame_id").alias("id"), "beg_us", "end_us")
    ts = F.col("ts_us") - F.when(F.col("seq") % 97 == 0, 1_000_000_000).otherwise(0)
    imu = fx.imu(spark, d).select("device", F.col("seq").alias("arrival"), F.lit("imu").alias("kind"), F.col("seq").alias("id"), ts.alias("beg_us"), ts.alias("end_us"))
    return frames.unionByName(imu)


@query(ORACLE_SQL["t12_delta_feed"])
def t12_stream_delta_queue(spark, d):
    """Deltas through a bounded queue that is a stream's state."""
    deltas = _deltas(spark, d)
    return _collected([(deltas, "frame_id")], lambda s: keyed.delta_queue(s, 40), name="t12").drop("batch")


@query(f"""WITH {fx.IMU}, f AS (SELECT *, coalesce((ts_us - lag(ts_us) OVER w >= 1800000000)::INTEGER, 0) AS o FROM imu WINDOW w AS (PARTITION BY device ORDER BY ts_us, seq)), g AS (SELECT *, sum(o) OVER (PARTITION BY device ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT device, count(*) AS n, min(ts_us) AS start_us, max(ts_us) AS last_us FROM g GROUP BY device, s HAVING max(ts_us) + 1800000000 <= (SELECT max(ts_us) FROM imu)""")
def t14_stream_sessions(spark, d):
    """Sessions that the watermark has closed: all but those that end within half an hour of the last sample."""
    rows = fx.imu(spark, d).select("device", "ts_us", F.timestamp_micros("ts_us").alias("ts"))
    return _collected([(rows, "ts_us")], lambda s: feeds.sessions(s, "30 minutes", "0 seconds"), name="t14").select("device", "n", "start_us", "last_us")


@query(f"""WITH {fx.IMU}, s AS (SELECT device, seq, CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 50 = 0 THEN 'NaN'::DOUBLE ELSE ax END AS ax FROM imu) SELECT count(*) AS observed, count(*) FILTER (ax IS NULL)::BIGINT AS unknown, count(*) FILTER (isnan(ax))::BIGINT AS not_finite, count(*) FILTER (device = 2)::BIGINT AS device_2 FROM s""")
def a18_observed_counters(spark, d):
    """Rejected samples, counted inside the running stream while it writes the good ones."""
    ax = F.when(F.col("seq") % 97 == 0, F.lit(None).cast("double")).when(F.col("seq") % 50 == 0, float("nan")).otherwise(F.col("ax"))
    rows = fx.imu(spark, d).select("device", "seq", ax.alias("ax"))
    path = shared_path(spark, "a18")
    rows.write.parquet(f"{path}/in")
    seen = spark.readStream.schema(rows.schema).parquet(f"{path}/in").observe(
        "observed", F.count(F.lit(1)).alias("observed"), F.count_if(F.col("ax").isNull()).alias("unknown"), F.count_if(F.isnan("ax")).alias("not_finite"), F.count_if(F.col("device") == 2).alias("device_2")
    )
    good = seen.where(F.col("ax").isNotNull() & ~F.isnan("ax"))
    total = feeds.run_observed(good, feeds.batch_sink(f"{path}/out"), f"{path}/state")
    names = ["observed", "unknown", "not_finite", "device_2"]
    return spark.createDataFrame([tuple(total[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(_ROUND_TRIP)
def s7_recording_stream(spark, d):
    """Recordings as a stream: two are there when the query starts, two come before it is started again."""
    spark.dataSource.register(lvx.LvxSource)
    top = shared_path(spark, "s7-recordings")
    path, state = f"{top}/out", f"{top}/state"
    rows = recorded_rows(spark, d)
    for names in (("r0", "r2"), ("r1", "r3")):
        recordings.write(rows.where(F.col("recording").isin(*names)), f"{top}/in")
        stream = spark.readStream.format("lvx").option("framesPerPartition", 50).load(f"{top}/in")
        feeds.run_to_end(stream, path=path, state=state)
    return recorded_points(feeds.results(spark, path, stream.schema).drop("batch"))


_LEDGER = f"""{_TILES}, c AS (SELECT tx, ty, tz, least(frame_id // 170, 2)::INTEGER AS step, count(DISTINCT frame_id) AS n FROM tiled GROUP BY ALL),
ev AS (SELECT tx, ty, tz, step, (sum(n) OVER (PARTITION BY tx, ty, tz ORDER BY step))::BIGINT AS v, step > 0 AND (tx + 2 * ty + 3 * tz + step) % 5 = 0 AS gone FROM c),
st AS (SELECT DISTINCT tx, ty, tz, u.consumer, -1 AS step, 0::BIGINT AS v, 0::BIGINT AS floor, false AS live, NULL::BIGINT AS handed, NULL::BIGINT AS pending, false AS del, false AS mark, NULL::BIGINT AS sent, false AS sent_del, false AS sent_mark
    FROM ev, (VALUES ('a'), ('b'), ('c')) u(consumer)
UNION ALL SELECT tx, ty, tz, consumer, step, v, floor, live, CASE WHEN sends THEN CASE WHEN NOT del THEN pending END ELSE handed END, CASE WHEN NOT sends THEN pending END, del AND NOT sends, mark AND NOT sends AND pending IS NOT NULL,
        CASE WHEN sends THEN pending END, del, mark AND NOT del
    FROM (SELECT *, here AND pending IS NOT NULL AND NOT (consumer = 'b' AND step = 1) AS sends FROM (
        SELECT tx, ty, tz, consumer, step, v, floor, live, handed, here, CASE WHEN touched THEN CASE WHEN live THEN floor + v WHEN handed IS NOT NULL THEN floor END ELSE pending END AS pending,
            CASE WHEN touched THEN NOT live ELSE del END AS del, mark OR (touched AND consumer = 'c' AND step = 2) AS mark FROM (
            SELECT *, here AND (changed OR (live AND consumer = 'c' AND step = 2)) AS touched FROM (
                SELECT s.tx, s.ty, s.tz, s.consumer, s.step + 1 AS step, coalesce(e.v, s.v) AS v, CASE WHEN e.gone THEN s.floor + e.v + 1 ELSE s.floor END AS floor, coalesce(NOT e.gone, s.live) AS live, s.handed, s.pending, s.del, s.mark,
                    s.consumer <> 'c' OR s.step + 1 >= 2 AS here, e.v IS NOT NULL AS changed
                FROM st s LEFT JOIN ev e ON e.tx = s.tx AND e.ty = s.ty AND e.tz = s.tz AND e.step = s.step + 1 WHERE s.step < 2)))))"""


def _delivered(spark, d):
    """Deliveries of three batches of tile changes: consumer b refuses the second, c joins at the third."""
    t = tiled(spark, d).withColumn("step", F.least(F.expr("frame_id div 170"), F.lit(2)))
    n = t.groupBy("tx", "ty", "tz", "step").agg(F.countDistinct("frame_id").alias("n"))
    v = F.sum("n").over(Window.partitionBy("tx", "ty", "tz").orderBy("step"))
    gone = (F.col("step") > 0) & ((F.col("tx") + 2 * F.col("ty") + 3 * F.col("tz") + F.col("step")) % 5 == 0)
    updates = n.select(*(F.col(c).cast("int").alias(c) for c in ("tx", "ty", "tz")), v.cast("long").alias("version"), gone.alias("deleted"), "step")
    path = shared_path(spark, "deliveries")
    put = ledger.to_folders(f"{path}/sent")

    def send(consumer, rows, batch_id):
        if (consumer, batch_id) == ("b", 1):
            raise ledger.NotDelivered
        put(consumer, rows, batch_id)

    book = ledger.Ledger(path, lambda k: ["a", "b"] if k < 2 else ["a", "b", "c"], lambda k: ["c"] if k == 2 else [], send)
    feeds.fed([(updates, "step")], lambda s: s.drop("step"), PIECES, lambda _: book, "t9", cut=lambda rows, time, n: [rows.where(F.col(time) == k) for k in range(n)])
    return book, spark.read.schema(f"{ledger.SENT}, consumer string, batch int").option("basePath", f"{path}/sent").parquet(f"{path}/sent")


@query(f"WITH RECURSIVE {_LEDGER} SELECT consumer, step AS batch, tx, ty, tz, sent AS version, sent_del AS deleted, sent_mark AS resync FROM st WHERE sent IS NOT NULL")
def t9_delivery_ledger(spark, d):
    """All deliveries (T9, T10, T15): a refused batch goes out again in its newest form, deletions only to who has the tile,
    a new consumer gets all live tiles."""
    return _delivered(spark, d)[1].select("consumer", "batch", "tx", "ty", "tz", "version", "deleted", "resync")


@query(f"WITH RECURSIVE {_LEDGER} SELECT tx, ty, tz, v AS version, floor, live FROM st WHERE consumer = 'a' AND step = 1 AND v > 0")
def t11_snapshot_at_batch(spark, d):
    """The map as the second batch left it, while later batches have come."""
    return _delivered(spark, d)[0].table(spark, "tiles", 1)
