"""Queries on scan features and exports (written, then read back)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom import fixtures as fx
from pointloom.functions import text as tx
from pointloom.operators import scan
from pointloom.operators import voxels as v
from pointloom.plans.alignment import _MSG, messages
from pointloom.plans.registry import query, r, sql_r
from pointloom.sources import export, recordings
from pointloom.sources.scratch import shared_path

_L = scan.Limits()
_GEO = f"""{fx.PTS}, n AS (SELECT frame_id, idx, x, y, z, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM pts WINDOW w AS (PARTITION BY frame_id ORDER BY idx)),
e AS (SELECT *, px - x AS ax, py - y AS ay, pz - z AS az, nx - x AS bx, ny - y AS by_, nz - z AS bz FROM n),
geo AS (SELECT frame_id, idx, x, y, z, sqrt(x*x + y*y) AS rng, coalesce(sqrt(bx*bx + by_*by_ + bz*bz), 0.0) AS gap, sqrt(ax*ax + ay*ay + az*az) AS gap_before,
    (x*ax + y*ay + z*az) / sqrt(x*x + y*y + z*z) / sqrt(ax*ax + ay*ay + az*az) AS angle_prev, (x*bx + y*by_ + z*bz) / sqrt(x*x + y*y + z*z) / sqrt(bx*bx + by_*by_ + bz*bz) AS angle_next,
    (ax*bx + ay*by_ + az*bz) / sqrt(ax*ax + ay*ay + az*az) / sqrt(bx*bx + by_*by_ + bz*bz) AS intersect_ FROM e)"""


def measured(spark, d):
    return scan.geometry(fx.pts(spark, d).select("frame_id", "idx", "x", "y", "z"), ["frame_id"], "idx")


@query(f"WITH {_GEO} SELECT frame_id, idx, {sql_r('rng')} AS range, {sql_r('gap')} AS gap, {sql_r('angle_prev')} AS angle_prev, {sql_r('angle_next')} AS angle_next, {sql_r('intersect_')} AS intersect_cos FROM geo")
def w3_scan_geometry(spark, d):
    return measured(spark, d).select("frame_id", "idx", r(F.col("range")).alias("range"), r(F.col("gap")).alias("gap"), r(F.col("angle_prev")).alias("angle_prev"), r(F.col("angle_next")).alias("angle_next"), r(F.col("intersect")).alias("intersect_cos"))


def _even(side: str) -> str:
    a, b, r1, r2 = ("g1", "g2", "r_1", "r_2") if side == "prev" else ("gap", "h1", "r1", "r2")
    return f"({r1} >= {_L.blind} AND {r2} >= {_L.blind} AND sqrt(greatest({a}, {b})) <= {_L.edge_a} * sqrt(least({a}, {b})) AND sqrt(greatest({a}, {b})) - sqrt(least({a}, {b})) <= {_L.edge_b})"


def _seen(rn: str, angle: str) -> str:
    return f"CASE WHEN {rn} < {_L.blind} AND rng > {_L.far} THEN 3 WHEN {rn} < {_L.blind} THEN 4 WHEN {angle} < {_L.up!r} THEN 2 WHEN {angle} > {_L.down!r} THEN 1 ELSE 0 END"


@query(f"""WITH {_GEO}, s AS (SELECT *, row_number() OVER w AS row_, count(*) OVER (PARTITION BY frame_id) AS total, lag(rng, 1) OVER w AS r_1, lag(rng, 2) OVER w AS r_2, lead(rng, 1) OVER w AS r1, lead(rng, 2) OVER w AS r2,
lag(gap, 1) OVER w AS g1, lag(gap, 2) OVER w AS g2, lead(gap, 1) OVER w AS h1 FROM geo WINDOW w AS (PARTITION BY frame_id ORDER BY idx)), k AS (SELECT *, {_seen('r_1', 'angle_prev')} AS p, {_seen('r1', 'angle_next')} AS q FROM s)
SELECT frame_id, idx, (CASE WHEN NOT (row_ > 3 AND row_ <= total - 3 AND rng >= {_L.blind} AND g1 >= 1e-16 AND gap >= 1e-16) THEN 0
WHEN p = 0 AND q = 1 AND gap > {_L.gap} AND gap > 4 * g1 THEN CASE WHEN intersect_ > {_L.cross!r} AND {_even('prev')} THEN 3 ELSE 0 END
WHEN p = 1 AND q = 0 AND g1 > {_L.gap} AND g1 > 4 * gap THEN CASE WHEN intersect_ > {_L.cross!r} AND {_even('next')} THEN 3 ELSE 0 END
WHEN p = 0 AND q = 3 THEN CASE WHEN {_even('prev')} THEN 3 ELSE 0 END WHEN p = 3 AND q = 0 THEN CASE WHEN {_even('next')} THEN 3 ELSE 0 END WHEN p > 0 AND q > 0 THEN 5 ELSE 0 END)::INTEGER AS label FROM k""")
def w4_local_labels(spark, d):
    return scan.local_labels(measured(spark, d), ["frame_id"], "idx").select("frame_id", "idx", "label")


@query()
def g1_scan_labels(spark, d):
    return scan.scan_labels(measured(spark, d), ["frame_id"], "idx").select("frame_id", "idx", "label")


@query(f"""WITH {fx.PTS}, l AS (SELECT frame_id, idx, x, y, z, (CASE (frame_id + idx * 3) % 11 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END) AS label FROM pts), s AS (SELECT *, sum((label NOT IN (1, 2))::INTEGER) OVER w AS run, row_number() OVER w AS k, max(CASE WHEN label NOT IN (1, 2) THEN idx + 1 ELSE 0 END) OVER (PARTITION BY frame_id) AS last_other FROM l WINDOW w AS (PARTITION BY frame_id ORDER BY idx)),
p AS (SELECT *, (row_number() OVER (PARTITION BY frame_id, run ORDER BY idx) - 1) // 3 AS part FROM s WHERE label IN (1, 2)), a AS (SELECT frame_id, run, part, count(*) AS n, arg_max(x, idx) AS lx, arg_max(y, idx) AS ly, arg_max(z, idx) AS lz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, bool_and(k < last_other) AS closed FROM p GROUP BY frame_id, run, part)
SELECT frame_id, 'surface' AS kind, n, {', '.join(f'{sql_r(f"CASE WHEN n = 3 THEN l{c} ELSE m{c} END", 8)} AS {c}' for c in 'xyz')} FROM a WHERE n = 3 OR closed
UNION ALL SELECT frame_id, 'corner', 1, {', '.join(f'{sql_r(c, 8)}' for c in 'xyz')} FROM l WHERE label = 3""")
def g2_surface_points(spark, d):
    kind = (F.col("frame_id") + F.col("idx") * 3) % 11
    labelled = fx.pts(spark, d).select("frame_id", "idx", "x", "y", "z", F.when(kind == 0, 0).when(kind == 1, 3).when(kind == 2, 1).otherwise(2).alias("label"))
    out = scan.surface_points(labelled, ["frame_id"], "idx", 3)
    return out.select("frame_id", "kind", "n", *(r(F.col(c), 8).alias(c) for c in "xyz"))


@query(f"WITH {fx.PTS}, n AS (SELECT *, frame_id % 4 AS recording_id FROM pts) SELECT recording_id, ((row_number() OVER (PARTITION BY recording_id ORDER BY frame_id, idx) - 1) // 500)::INTEGER AS chunk, frame_id, idx FROM n")
def s8_chunk_export(spark, d):
    path = shared_path(spark, "chunks")
    export.write_chunks(fx.pts(spark, d).withColumn("recording_id", F.col("frame_id") % 4), path, 500, ["recording_id"], ["frame_id", "idx"])
    return spark.read.parquet(path).select(F.col("recording_id").cast("bigint").alias("recording_id"), F.col("chunk").cast("int").alias("chunk"), "frame_id", "idx")


@query(f"WITH {_MSG} SELECT topic, recording_id::BIGINT AS recording_id, count(*) AS n, max(sensor_us) AS last_us FROM messages WHERE topic IN ('view', 'click') GROUP BY topic, recording_id")
def s9_topic_log(spark, d):
    path = shared_path(spark, "topics")
    export.write_topics(messages(spark, d), path, ["view", "click"], "sensor_us")
    back = [spark.read.parquet(f"{path}/{t}").withColumn("topic", F.lit(t)) for t in ("view", "click")]
    both = back[0].unionByName(back[1])
    return both.groupBy("topic", F.col("recording_id").cast("bigint").alias("recording_id")).agg(F.count(F.lit(1)).alias("n"), F.max("sensor_us").alias("last_us"))


@query(f"""WITH {fx.PTS_BIG}, k AS (SELECT *, floor(x / 2.0)::BIGINT AS gx, floor(y / 2.0)::BIGINT AS gy, floor(z / 2.0)::BIGINT AS gz FROM pts_big), n AS (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY ord DESC) AS n FROM k) SELECT gx, gy, gz, x, y, z, intensity FROM n WHERE n = 1""")
def s10_map_export(spark, d):
    path = shared_path(spark, "map")
    cells = v.with_policy(v.voxel_keys(fx.pts_big(spark, d), 2.0), "latest", "ord", ["gx", "gy", "gz"]).drop("n")
    export.write_map(cells, path)
    return spark.read.parquet(path)


@query("SELECT event_id AS seq, user_id AS points, round(value, 2) AS total_ms, 'processed' AS event FROM events")
def s11_text_log(spark, d):
    path = shared_path(spark, "log")
    rows = fx.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("points"), F.round("value", 2).alias("total_ms"))
    export.write_text_log(rows, path, "processed", ["seq", "points", "total_ms"])
    m = spark.read.text(path).select(tx.log_fields(F.col("value")).alias("m"))
    return m.select(tx.log_value(F.col("m"), "seq", "bigint").alias("seq"), tx.log_value(F.col("m"), "points", "bigint").alias("points"), tx.log_value(F.col("m"), "total_ms", "double").alias("total_ms"), tx.log_value(F.col("m"), "event", "string").alias("event"))


@query(f"WITH {fx.POSES} SELECT device AS recording_id, ts_us AS time_ns, {sql_r('px')} AS px FROM poses")
def s11_trajectory_csv(spark, d):
    path = shared_path(spark, "trajectory")
    export.write_trajectory(fx.poses(spark, d).select(F.col("device").alias("recording_id"), F.col("ts_us").alias("time_ns"), "px"), path)
    back = spark.read.option("header", True).schema("recording_id bigint, time_ns bigint, px double").csv(path)
    return back.withColumn("px", r(F.col("px")))


# -- recordings: written as lvx files to the shared folder, indexed and read back by tasks

_RECORDED = f"""{fx.PTS}, rec AS (SELECT 'r' || frame_id % 4 AS recording, frame_id // 4 // 16 AS frame, (row_number() OVER (PARTITION BY frame_id % 4, frame_id // 4 // 16 ORDER BY frame_id, idx) - 1)::INTEGER AS place,
    round(x * 1000)::INTEGER AS x_mm, round(y * 1000)::INTEGER AS y_mm, round(z * 1000)::INTEGER AS z_mm, (intensity::INTEGER % 256)::INTEGER AS reflectivity, tag FROM pts)"""


def recorded_rows(spark, d):
    """The cloud as four recordings with frames of 16 clouds, 50 ms apart."""
    p = fx.pts(spark, d)
    return p.select(
        F.concat(F.lit("r"), F.col("frame_id") % 4).alias("recording"), F.expr("frame_id div 4 div 16").alias("frame"), (F.expr("frame_id div 4 div 16") * 50_000_000).alias("ts_ns"), (F.col("frame_id") * 21 + F.col("idx")).alias("idx"),
        *(F.round(F.col(c) * 1000).cast("int").alias(f"{c}_mm") for c in "xyz"), (F.col("intensity").cast("int") % 256).alias("reflectivity"), "tag",
    )


def _name():
    return F.regexp_extract("recording", "([^/]+)-[0-9]+[.]lvx$", 1)


def _frame():
    return F.regexp_extract("recording", "-([0-9]+)[.]lvx$", 1).cast("long") * recordings.FILE_FRAMES + F.col("frame_index")


def recorded_points(points):
    """Points read back, without what fills up packets."""
    p = points.where(F.col("tag") != recordings.FILLER)
    return p.select(_name().alias("recording"), _frame().alias("frame"), F.col("idx").alias("place"), *(F.round(F.col(c) * 1000).cast("int").alias(f"{c}_mm") for c in "xyz"), "reflectivity", "tag")


def _recorded(spark, d):
    """Written, and the index of its frames."""
    path = shared_path(spark, "recordings")
    recordings.write(recorded_rows(spark, d), path)
    return recordings.index(spark, path)


_ROUND_TRIP = f"WITH {_RECORDED} SELECT recording, frame, place, x_mm, y_mm, z_mm, reflectivity, tag FROM rec"


@query(_ROUND_TRIP)
def s1_recording_round_trip(spark, d):
    return recorded_points(recordings.points(_recorded(spark, d)))


@query(f"WITH {_RECORDED} SELECT recording, frame, count(*) AS n, sum(x_mm)::BIGINT AS sum_x FROM rec WHERE recording <> 'r2' AND frame >= 3 AND frame < 6 GROUP BY recording, frame")
def s5_frame_seek(spark, d):
    """Frames of a time range of some recordings: only they are opened. A recording is many files, and an index has times from
    its file's first packet: the range is in the recordings' own clock."""
    time_ns = F.col("base_ns") + F.round(F.col("time_s") * 1e9).cast("bigint")
    wanted = _recorded(spark, d).where((_name() != "r2") & (_frame() >= 3) & (time_ns < 6 * 50_000_000))
    return recorded_points(recordings.points(wanted)).groupBy("recording", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum("x_mm").alias("sum_x"))
