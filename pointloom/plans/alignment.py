"""Queries on time alignment, poses, motion and messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom import fixtures as fx
from pointloom.functions import geometry as g
from pointloom.operators import motion, sync
from pointloom.plans.registry import query, r, sql_r

XYZ = ("x", "y", "z")

_COVER = f"""{fx.FRAMES}, {fx.IMU}, run AS (SELECT *, max(end_us) OVER (PARTITION BY device ORDER BY beg_us, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_us,
    max(end_us) OVER (PARTITION BY device ORDER BY beg_us, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high_us FROM frames),
last AS (SELECT device, max(ts_us) AS last_us FROM imu GROUP BY device),
cover AS (SELECT r.*, CASE WHEN last_us IS NULL THEN 'no_final_imu' WHEN high_us > last_us THEN 'no_final_imu_coverage' ELSE 'covered' END AS status FROM run r LEFT JOIN last USING (device))"""


@query(f"WITH {fx.PTS} SELECT frame_id, {sql_r('frame_id * 0.1 + greatest(max(offset_ms), 0) / 1000.0', 9)} AS end_s FROM pts WHERE idx <= frame_id % 21 GROUP BY frame_id")
def a1_frame_end(spark, d):
    pts = fx.pts(spark, d).where(F.col("idx") <= F.col("frame_id") % 21).withColumn("begin_s", F.col("frame_id") * 0.1)
    return sync.frame_ends(pts).select("frame_id", r(F.col("end_s"), 9).alias("end_s"))


@query(f"WITH {_COVER} SELECT c.device, frame_id, seq, ts_us FROM cover c JOIN imu i ON c.device = i.device AND i.ts_us <= c.end_us AND (c.low_us IS NULL OR i.ts_us > c.low_us) WHERE status = 'covered'")
def j1_interval_join(spark, d):
    return sync.interval_join(fx.frames(spark, d), fx.imu(spark, d))


@query(f"WITH {_COVER} SELECT device, status AS reason, count(*) AS frames FROM cover WHERE status <> 'covered' GROUP BY device, status")
def t6_tail_report(spark, d):
    return sync.tail_report(fx.frames(spark, d), fx.imu(spark, d))


@query(f"""WITH {fx.FRAMES}, {fx.POSES} SELECT f.device, f.frame_id, f.beg_us, arg_max(p.pose_id, p.ts_us) AS pose_id, arg_max(p.px, p.ts_us) AS px
FROM frames f LEFT JOIN poses p ON p.device = f.device AND p.ts_us < f.beg_us GROUP BY f.device, f.frame_id, f.beg_us""")
def j2_as_of_join(spark, d):
    frames = fx.frames(spark, d).select("device", "frame_id", F.col("beg_us").alias("ts_us"))
    found = sync.as_of(frames, fx.poses(spark, d), ["device"], "ts_us", ["pose_id", "px"])
    return found.select("device", "frame_id", F.col("ts_us").alias("beg_us"), "pose_id", "px")


#: Planar poses, a point in front of the sensor, moved to a frame end with heading 0 at the origin.
_MOVE = f"""{fx.FRAMES}, {fx.POSES}, m AS (SELECT f.device, f.frame_id, f.beg_us, arg_max(p.ts_us, p.ts_us) AS pose_us, arg_max(p.px, p.ts_us) AS px, arg_max(p.yaw, p.ts_us) AS yaw
FROM frames f JOIN poses p ON p.device = f.device AND p.ts_us < f.beg_us GROUP BY f.device, f.frame_id, f.beg_us),
s AS (SELECT *, least((beg_us - pose_us) / 1e6, 5.0) AS dt FROM m)"""


def _moving(spark, d):
    frames = fx.frames(spark, d).select("device", "frame_id", F.col("beg_us").alias("ts_us"))
    met = sync.as_of(frames, fx.poses(spark, d).withColumn("pose_us", F.col("ts_us")), ["device"], "ts_us", ["pose_us", "px", "yaw"]).where("pose_us IS NOT NULL")
    return met.withColumn("dt", F.least((F.col("ts_us") - F.col("pose_us")) / 1e6, F.lit(5.0)))


@query(f"""WITH {_MOVE} SELECT device, frame_id, {sql_r("10 * cos(yaw + 0.1 * dt) + px + 0.5 * dt + 0.5 * 0.2 * dt * dt", 5)} AS x, {sql_r("10 * sin(yaw + 0.1 * dt)", 5)} AS y, 1.0::DOUBLE AS z FROM s""")
def j3_motion_compensation(spark, d):
    zero, one = F.lit(0.0), F.lit(1.0)
    out = motion.compensated([F.lit(10.0), zero, one], F.col("dt"), g.rotation_z(F.col("yaw")), [F.lit(0.5), zero, zero], [F.col("px"), zero, zero], [F.lit(0.2), zero, zero], [zero, zero, F.lit(0.1)], g.identity(), [zero] * 3)
    return _moving(spark, d).select("device", "frame_id", *(r(v, 5).alias(c) for v, c in zip(out, XYZ, strict=True)))


@query(f"""WITH {fx.PTS}, pose AS (SELECT event_id % 500 AS frame_id, avg(value) AS px, avg((event_id % 360) * (3.14159265358 / 180.0)::DOUBLE) AS yaw FROM events GROUP BY 1)
SELECT frame_id, idx, {sql_r("cos(yaw) * (x + 0.1) - sin(yaw) * (y - 0.2) + px", 5)} AS x, {sql_r("sin(yaw) * (x + 0.1) + cos(yaw) * (y - 0.2)", 5)} AS y, {sql_r("z + 0.3", 5)} AS z FROM pts JOIN pose USING (frame_id)""")
def p11_rigid_transform(spark, d):
    pose = fx.table(spark, d, "events").groupBy((F.col("event_id") % 500).alias("frame_id")).agg(F.avg("value").alias("px"), F.avg((F.col("event_id") % 360) * (g.PI_M / 180.0)).alias("yaw"))
    world = g.to_world([F.col(c) for c in XYZ], g.rotation_z(F.col("yaw")), [F.col("px"), F.lit(0.0), F.lit(0.0)], g.identity(), [F.lit(0.1), F.lit(-0.2), F.lit(0.3)])
    return fx.pts(spark, d).join(pose, "frame_id").select("frame_id", "idx", *(r(v, 5).alias(c) for v, c in zip(world, XYZ, strict=True)))


# rotations about an axis (0.36, 0.48, 0.8) by an angle of -2.9 .. 2.9
_ANGLE = "(event_id % 580 - 290) / 100.0::DOUBLE"
_K = {"x": 0.36, "y": 0.48, "z": 0.8}


def _rotations(spark, d):
    angle = (F.col("event_id") % 580 - 290) / 100.0
    return fx.table(spark, d, "events").select("event_id", angle.alias("angle")), [F.lit(_K[c]) for c in XYZ]


def _rodrigues_sql() -> list[str]:
    x, y, z = _K.values()
    k = [[0, -z, y], [z, 0, -x], [-y, x, 0]]
    k2 = [[sum(k[i][m] * k[m][j] for m in range(3)) for j in range(3)] for i in range(3)]
    return [f"(({float(i == j)}) + sin(a) * ({k[i][j]}) + (1 - cos(a)) * ({k2[i][j]}))" for i in range(3) for j in range(3)]


_M = _rodrigues_sql()


@query(f"""WITH s AS (SELECT event_id, {_ANGLE} AS a FROM events) SELECT event_id, {', '.join(f'{sql_r(f"CASE WHEN abs(a) > 1e-5 THEN {m} ELSE {float(i % 4 == 0)} END", 8)} AS r{i}' for i, m in enumerate(_M))} FROM s""")
def f5_exponential(spark, d):
    rows, axis = _rotations(spark, d)
    m = g.exp([F.col("angle") * a for a in axis])
    return rows.select("event_id", *(r(v, 8).alias(f"r{i}") for i, v in enumerate(m)))


@query(f"""WITH s AS (SELECT event_id, {_ANGLE} AS a FROM events) SELECT event_id, {', '.join(f"{sql_r(f'a * {_K[c]}', 5)} AS l{c}" for c in XYZ)} FROM s""")
def f7_logarithm(spark, d):
    rows, axis = _rotations(spark, d)
    found = g.log(g.exp([F.col("angle") * a for a in axis]))
    return rows.select("event_id", *(r(v, 5).alias(f"l{c}") for v, c in zip(found, XYZ, strict=True)))


@query(f"""WITH s AS (SELECT event_id, {_ANGLE} AS a FROM events), m AS (SELECT event_id, {', '.join(f'{m} AS r{i}' for i, m in enumerate(_M))} FROM s)
SELECT event_id, {sql_r('atan2(r7, r8)')} AS roll, {sql_r('atan2(-r6, sqrt(r0*r0 + r3*r3))')} AS pitch, {sql_r('atan2(r3, r0)')} AS yaw FROM m WHERE sqrt(r0*r0 + r3*r3) >= 1e-6""")
def f8_euler(spark, d):
    rows, axis = _rotations(spark, d)
    roll, pitch, yaw = g.euler(g.exp([F.col("angle") * a for a in axis]))
    return rows.select("event_id", r(roll).alias("roll"), r(pitch).alias("pitch"), r(yaw).alias("yaw"))


@query(f"""WITH s AS (SELECT event_id, {_ANGLE} AS a FROM events), q AS (SELECT event_id, 0.36 * sin(a / 2) AS x, 0.48 * sin(a / 2) AS y, 0.8 * sin(a / 2) AS z, cos(a / 2) AS w FROM s), t AS (SELECT *, x*x + y*y + z*z + w*w AS u, w*y - z*x AS t FROM q)
SELECT event_id, {sql_r('57.3 * CASE WHEN t > 0.49999 * u THEN 2 * atan2(x, w) WHEN t < -0.49999 * u THEN -2 * atan2(x, w) ELSE atan2(2*x*w + 2*y*z, -x*x - y*y + z*z + w*w) END', 5)} AS roll,
{sql_r('57.3 * CASE WHEN t > 0.49999 * u THEN pi() / 2 WHEN t < -0.49999 * u THEN -pi() / 2 ELSE asin(greatest(-1.0, least(1.0, 2 * t / u))) END', 5)} AS pitch,
{sql_r('57.3 * CASE WHEN abs(t) > 0.49999 * u THEN 0 ELSE atan2(2*z*w + 2*y*x, x*x - y*y - z*z + w*w) END', 5)} AS yaw FROM t""")
def f9_quaternion_euler(spark, d):
    rows, axis = _rotations(spark, d)
    half = F.col("angle") / 2
    roll, pitch, yaw = g.quaternion_euler([*(a * F.sin(half) for a in axis), F.cos(half)])
    return rows.select("event_id", r(roll, 5).alias("roll"), r(pitch, 5).alias("pitch"), r(yaw, 5).alias("yaw"))


@query(f"""WITH s AS (SELECT event_id, {_ANGLE} AS a FROM events) SELECT event_id, {', '.join(f'{sql_r(m, 8)} AS r{i}' for i, m in enumerate(_M))},
{sql_r('0.36 * sin(a / 2) * sign(cos(a / 2))', 6)} AS qx, {sql_r('0.48 * sin(a / 2) * sign(cos(a / 2))', 6)} AS qy, {sql_r('0.8 * sin(a / 2) * sign(cos(a / 2))', 6)} AS qz, {sql_r('abs(cos(a / 2))', 6)} AS qw FROM s""")
def f10_quaternion_matrix(spark, d):
    rows, axis = _rotations(spark, d)
    half = F.col("angle") / 2
    m = g.from_quaternion([*(a * F.sin(half) for a in axis), F.cos(half)])
    held = rows.select("event_id", *(v.alias(f"m{i}") for i, v in enumerate(m)))
    q = g.to_quaternion([F.col(f"m{i}") for i in range(9)])
    sign = F.signum(q[3])
    return held.select("event_id", *(r(F.col(f"m{i}"), 8).alias(f"r{i}") for i in range(9)), *(r(v * sign, 6).alias(n) for v, n in zip(q, ("qx", "qy", "qz", "qw"), strict=True)))


@query(f"""WITH s AS (SELECT event_id, value, {_ANGLE} AS a FROM events), m AS (SELECT event_id, value, {', '.join(f'{m} AS r{i}' for i, m in enumerate(_M))} FROM s)
SELECT event_id, {sql_r('r0 * value + r1 * 2 + r2 * 3', 5)} AS x, {sql_r('r3 * value + r4 * 2 + r5 * 3', 5)} AS y, {sql_r('r6 * value + r7 * 2 + r8 * 3', 5)} AS z, {sql_r('r0*r0 + r1*r1 + r2*r2', 6)} AS unit FROM m""")
def f4_f6_matrix_algebra(spark, d):
    angle = (F.col("event_id") % 580 - 290) / 100.0
    rows = fx.table(spark, d, "events").select("event_id", "value", angle.alias("angle"))
    m = g.exp([F.col("angle") * F.lit(_K[c]) for c in XYZ])
    held = rows.select("event_id", "value", *(v.alias(f"m{i}") for i, v in enumerate(m)))
    m = [F.col(f"m{i}") for i in range(9)]
    x, y, z = g.apply(m, [F.col("value"), F.lit(2.0), F.lit(3.0)])
    return held.select("event_id", r(x, 5).alias("x"), r(y, 5).alias("y"), r(z, 5).alias("z"), r(g.multiply(m, g.transpose(m))[0]).alias("unit"))


@query(f"""WITH s AS (SELECT event_id, value, {_ANGLE} AS a FROM events) SELECT event_id, {', '.join(f"{sql_r(f'0.4 * {_K[c]}', 5)} AS d{c}" for c in XYZ)}, {sql_r('value * 0.5', 5)} AS moved FROM s""")
def f11_box_plus_minus(spark, d):
    """A pose, a step added to it, and the step found again from the two poses."""
    angle = (F.col("event_id") % 580 - 290) / 100.0
    rows = fx.table(spark, d, "events").select("event_id", "value", angle.alias("angle"))
    axis = [F.lit(_K[c]) for c in XYZ]
    held = rows.select("event_id", "value", *(v.alias(f"m{i}") for i, v in enumerate(g.exp([F.col("angle") * a for a in axis]))))
    old, at = [F.col(f"m{i}") for i in range(9)], [F.col("value"), F.lit(0.0), F.lit(0.0)]
    new, to = g.box_plus(old, at, [a * 0.4 for a in axis], [F.col("value") * 0.5, F.lit(0.0), F.lit(0.0)])
    both = held.select("event_id", "value", *(f"m{i}" for i in range(9)), *(v.alias(f"n{i}") for i, v in enumerate(new)), to[0].alias("to_x"))
    turn, shift = g.box_minus([F.col(f"n{i}") for i in range(9)], [F.col("to_x"), F.lit(0.0), F.lit(0.0)], old, at)
    return both.select("event_id", *(r(v, 5).alias(f"d{c}") for v, c in zip(turn, XYZ, strict=True)), r(shift[0], 5).alias("moved"))


_REST = f"""{fx.IMU}, six AS (SELECT device, seq, ts_us, ax / 100 AS ax, ax / 200 AS ay, 9.5 + ax / 1000 AS az FROM imu),
k AS (SELECT *, row_number() OVER w AS k, avg(ax) OVER u AS mx, avg(ay) OVER u AS my, avg(az) OVER u AS mz FROM six WINDOW w AS (PARTITION BY device ORDER BY ts_us, seq), u AS (PARTITION BY device ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING)),
s AS (SELECT device, count(*) AS n, avg(ax) AS ax, avg(ay) AS ay, avg(az) AS az, sum(pow(ax - mx, 2) * (k - 1) / k) / count(*) AS cx FROM k GROUP BY device)"""


@query(f"WITH {_REST} SELECT device, n, {sql_r('ax', 7)} AS mean_ax, {sql_r('cx', 7)} AS cov_ax, {', '.join(f'{sql_r(f"-{a} / sqrt(ax*ax + ay*ay + az*az) * 9.81", 7)} AS grav_{c}' for a, c in (('ax', 'x'), ('ay', 'y'), ('az', 'z')))}, n >= 10 AS done FROM s")
def a10_rest_statistics(spark, d):
    six = fx.imu(spark, d).select("device", "seq", "ts_us", (F.col("ax") / 100).alias("ax"), (F.col("ax") / 200).alias("ay"), (9.5 + F.col("ax") / 1000).alias("az"))
    found = motion.rest_statistics(six, ["device"], ["ts_us", "seq"], ("ax", "ay", "az"))
    return found.select("device", "n", *(r(F.col(c), 7).alias(c) for c in ("mean_ax", "cov_ax", "grav_x", "grav_y", "grav_z")), "done")


@query(f"WITH {_REST} SELECT i.device, seq, {sql_r('i.ax * 9.81 / sqrt(s.ax*s.ax + s.ay*s.ay + s.az*s.az)')} AS acc FROM six i JOIN s USING (device)")
def f13_normalised_acc(spark, d):
    six = fx.imu(spark, d).select("device", "seq", (F.col("ax") / 100).alias("ax"), (F.col("ax") / 200).alias("ay"), (9.5 + F.col("ax") / 1000).alias("az"))
    mean = six.groupBy("device").agg(*(F.avg(a).alias(f"m_{a}") for a in ("ax", "ay", "az")))
    return six.join(mean, "device").select("device", "seq", r(motion.normalised_acc(F.col("ax"), g.norm([F.col(f"m_{a}") for a in ("ax", "ay", "az")]))).alias("acc"))


@query(f"""WITH {fx.IMU}, e AS (SELECT device, min(ts_us) + 3600000000 AS end_us FROM imu GROUP BY device), n AS (SELECT i.device, seq, ts_us, ax, lead(ts_us) OVER w AS tail_us, lead(ax) OVER w AS bx, end_us FROM imu i JOIN e USING (device) WINDOW w AS (PARTITION BY device ORDER BY ts_us, seq))
SELECT device, seq, ts_us, tail_us, {sql_r('(ax + bx) * 0.5')} AS ax_mid, {sql_r('(tail_us - greatest(ts_us, end_us)) / 1e6')} AS dt_s FROM n WHERE tail_us IS NOT NULL AND tail_us >= end_us""")
def w5_midpoints(spark, d):
    imu = fx.imu(spark, d)
    ends = imu.groupBy("device").agg((F.min("ts_us") + 3_600_000_000).alias("end_us"))
    return motion.midpoints(imu.join(ends, "device"), ["device"], ("ax",), "end_us").select("device", "seq", "ts_us", "tail_us", r(F.col("ax_mid")).alias("ax_mid"), r(F.col("dt_s")).alias("dt_s"))


_SPIN = "pow(ax / 1000, 2) + 0.0001"
_ROTATED = (
    "(1 - 2 * (qy*qy + qz*qz)) * n.ax / 100 + 2 * (qx*qy - qw*qz) * 0.1 + 2 * (qx*qz + qw*qy) * 9.81", "2 * (qx*qy + qw*qz) * n.ax / 100 + (1 - 2 * (qx*qx + qz*qz)) * 0.1 + 2 * (qy*qz - qw*qx) * 9.81",
    "2 * (qx*qz - qw*qy) * n.ax / 100 + 2 * (qy*qz + qw*qx) * 0.1 + (1 - 2 * (qx*qx + qy*qy)) * 9.81 - 9.81",
)


@query(f"""WITH RECURSIVE {fx.IMU}, w AS (SELECT *, ts_us // 604800000000 AS week FROM imu),
d AS (SELECT *, least(coalesce((ts_us - lag(ts_us) OVER t) / 1e6, 0), 1) AS dt, row_number() OVER (PARTITION BY device, week ORDER BY seq) AS k FROM w WINDOW t AS (PARTITION BY device, week ORDER BY ts_us, seq)),
n AS (SELECT device, week, seq, k, dt, ax, cos(sqrt({_SPIN}) * dt / 2) AS ew, sin(sqrt({_SPIN}) * dt / 2) * 0.01 / sqrt({_SPIN}) AS ey, sin(sqrt({_SPIN}) * dt / 2) * ax / 1000 / sqrt({_SPIN}) AS ez FROM d),
f AS (SELECT device, week, 0::BIGINT AS k, 0::BIGINT AS seq, 1.0::DOUBLE AS qw, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS vz, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, 0.0::DOUBLE AS pz FROM n WHERE n.k = 1
UNION ALL SELECT n.device, n.week, n.k, n.seq, qw*ew - qy*ey - qz*ez, qx*ew + qy*ez - qz*ey, qw*ey - qx*ez + qy*ew, qw*ez + qx*ey + qz*ew,
    vx + ({_ROTATED[0]}) * dt, vy + ({_ROTATED[1]}) * dt, vz + ({_ROTATED[2]}) * dt, px + vx * dt, py + vy * dt, pz + vz * dt
    FROM f JOIN n ON n.device = f.device AND n.week = f.week AND n.k = f.k + 1)
SELECT device, week, seq, {", ".join(f"{sql_r(f'p{c}', 2)} AS p{c}, {sql_r(f'v{c}', 4)} AS v{c}" for c in XYZ)}, {sql_r("1 - 2 * (qy*qy + qz*qz)")} AS r0, {sql_r("2 * (qx*qy - qw*qz)")} AS r1, {sql_r("2 * (qx*qz - qw*qy)")} AS r6 FROM f WHERE k > 0""")
def w13_open_loop_poses(spark, d):
    """Poses from each device's samples by week: a scan with a product that doesn't commute; the twin walks step by step."""
    imu = fx.imu(spark, d)
    by_week = Window.partitionBy("device", "week").orderBy("ts_us", "seq")
    steps = imu.withColumn("week", F.floor(F.col("ts_us") / 604_800_000_000).cast("bigint")).withColumn("dt", F.least(F.coalesce((F.col("ts_us") - F.lag("ts_us").over(by_week)) / 1e6, F.lit(0.0)), F.lit(1.0)))
    six = steps.select("device", "week", "seq", "dt", (F.col("ax") / 100).alias("ax"), F.lit(0.1).alias("ay"), F.lit(9.81).alias("az"), F.lit(0.0).alias("gx"), F.lit(0.01).alias("gy"), (F.col("ax") / 1000).alias("gz"))
    found = motion.integrated(six, ["device", "week"], "seq")
    return found.select("device", "week", "seq", *(r(F.col(f"p{c}"), 2).alias(f"p{c}") for c in XYZ), *(r(F.col(f"v{c}"), 4).alias(f"v{c}") for c in XYZ), *(r(F.col(c)).alias(c) for c in ("r0", "r1", "r6")))


@query(f"""WITH {fx.IMU}, f AS (SELECT *, coalesce((ts_us - lag(ts_us) OVER w > 600000000)::INTEGER, 0) AS o FROM imu WINDOW w AS (PARTITION BY device ORDER BY ts_us, seq)), g AS (SELECT *, sum(o) OVER (PARTITION BY device ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS frame FROM f)
SELECT device, frame::BIGINT AS frame, count(*) AS n, max(ts_us) AS frame_us FROM g GROUP BY device, frame""")
def w9_gap_frames(spark, d):
    found = sync.gap_frames(fx.imu(spark, d), 600_000_000, ["device"])
    return found.groupBy("device", "frame").agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("frame_us"))


@query(f"""WITH {fx.IMU}, j AS (SELECT device, seq, ts_us - CASE WHEN seq % 97 = 0 THEN 1000000000 ELSE 0 END AS ts_us FROM imu), f AS (SELECT *, coalesce((ts_us < lag(ts_us) OVER w)::INTEGER, 0) AS o FROM j WINDOW w AS (PARTITION BY device ORDER BY seq))
SELECT device, seq, ts_us, (sum(o) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS epoch FROM f""")
def w10_clock_epochs(spark, d):
    late = fx.imu(spark, d).select("device", "seq", (F.col("ts_us") - F.when(F.col("seq") % 97 == 0, 1_000_000_000).otherwise(0)).alias("ts_us"))
    return sync.clock_epochs(late, ["device"])


_MSG = "messages AS (SELECT user_id % 16 AS recording_id, event_type AS topic, event_id AS seq, epoch_us(ts) AS sensor_us, value FROM events)"


def messages(spark, d):
    e = fx.table(spark, d, "events")
    return e.select((F.col("user_id") % 16).alias("recording_id"), F.col("event_type").alias("topic"), F.col("event_id").alias("seq"), fx.micros(F.col("ts")).alias("sensor_us"), "value")


@query(f"""WITH {_MSG}, r AS (SELECT *, CASE topic WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS rank FROM messages WHERE NOT (recording_id % 3 = 0 AND topic = 'purchase')), b AS (SELECT recording_id, min(rank) AS best FROM r GROUP BY recording_id)
SELECT recording_id, topic, seq FROM r JOIN b USING (recording_id) WHERE rank = best""")
def s4_topic_scan(spark, d):
    m = messages(spark, d).where("NOT (recording_id % 3 = 0 AND topic = 'purchase')")
    return sync.best_topic(m, ["purchase", "click", "view"]).select("recording_id", "topic", "seq")


@query(f"""WITH {_MSG}, l AS (SELECT recording_id, max(sensor_us) AS last_us, min(sensor_us) AS first_us FROM messages GROUP BY recording_id)
SELECT recording_id, seq, sensor_us FROM messages JOIN l USING (recording_id) WHERE sensor_us >= least(first_us + recording_id * 200000000000, last_us)""")
def s5_time_seek(spark, d):
    m = messages(spark, d)
    first = m.groupBy("recording_id").agg(F.min("sensor_us").alias("first_us"))
    return sync.seek(m.join(first, "recording_id"), "sensor_us", F.col("first_us") + F.col("recording_id") * 200_000_000_000).select("recording_id", "seq", "sensor_us")


@query(f"WITH {_MSG} SELECT recording_id, topic, count(*) AS n, min(sensor_us) AS start_us, max(sensor_us) AS end_us, {sql_r('(max(sensor_us) - min(sensor_us)) / 1e6')} AS duration_s FROM messages GROUP BY recording_id, topic")
def s6_recording_summary(spark, d):
    return sync.recording_summary(messages(spark, d)).withColumn("duration_s", r(F.col("duration_s")))


@query(f"""WITH {_MSG} SELECT recording_id, seq, (row_number() OVER (PARTITION BY recording_id ORDER BY CASE WHEN topic IN ('view', 'click') THEN sensor_us ELSE 0 END, seq))::INTEGER AS place FROM messages""")
def o1_sensor_time_order(spark, d):
    return sync.by_sensor_time(messages(spark, d), ["view", "click"]).select("recording_id", "seq", "place")


@query(f"""WITH {_MSG} SELECT seq, '{{"timestamp":{{"sec":' || sensor_us // 1000000 || ',"nsec":' || (sensor_us % 1000000) * 1000 || '}},"frame_id":"imu_link","linear_acceleration":{{"x":' || recording_id || ',"y":' || seq % 7 || ',"z":' || 9 || '}}}}' AS json FROM messages""")
def s13_imu_json(spark, d):
    from pointloom.sources import feeds

    m = messages(spark, d).select("seq", F.col("sensor_us").alias("ts_us"), F.col("recording_id").alias("ax"), (F.col("seq") % 7).alias("ay"), F.lit(9).alias("az"))
    return m.select("seq", feeds.imu_json(F.col("ts_us"), "imu_link", acc=("ax", "ay", "az")).alias("json"))


@query("SELECT s_suppkey, n_name AS device, s_suppkey % 360 AS yaw_deg FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j7_device_lookup(spark, d):
    supplier, nation = fx.table(spark, d, "supplier"), fx.table(spark, d, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left").select("s_suppkey", F.col("n_name").alias("device"), (F.col("s_suppkey") % 360).alias("yaw_deg"))


@query(f"""WITH {fx.PACKETS} SELECT (ts_ns // 50000000)::BIGINT AS frame, count(DISTINCT packet_no) AS packets, count(*) AS points FROM packets WHERE data_type <> 6 GROUP BY 1""")
def t13_tumbling_frames(spark, d):
    pk = fx.packets(spark, d).where("data_type <> 6")
    return pk.groupBy(F.expr("ts_ns div 50000000").alias("frame")).agg(F.countDistinct("packet_no").alias("packets"), F.count(F.lit(1)).alias("points"))


@query(f"""WITH {fx.IMU}, f AS (SELECT *, coalesce((ts_us - lag(ts_us) OVER w >= 1800000000)::INTEGER, 0) AS o FROM imu WINDOW w AS (PARTITION BY device ORDER BY ts_us, seq)), g AS (SELECT *, sum(o) OVER (PARTITION BY device ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT device, count(*) AS n, min(ts_us) AS start_us, max(ts_us) AS last_us FROM g GROUP BY device, s""")
def t14_gap_sessions(spark, d):
    imu = fx.imu(spark, d).withColumn("ts", F.timestamp_micros("ts_us"))
    s = imu.groupBy("device", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"))
    return s.select("device", "n", "start_us", "last_us")
