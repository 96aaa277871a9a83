"""Queries on points and voxels: decoding, filters, sampling, downsampling, map statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom import fixtures as fx
from pointloom.functions import geometry as g
from pointloom.functions import text as tx
from pointloom.operators import points as p
from pointloom.operators import voxels as v
from pointloom.plans.registry import query, r, sql_r

XYZ = ("x", "y", "z")


@query(f"""WITH {fx.PACKETS}, layout(data_type, returns) AS (VALUES (0,1),(1,1),(2,1),(3,1),(4,2),(5,2),(7,3),(8,3))
SELECT packet_no, idx, p.data_type, (idx // returns)::INTEGER AS raw_index, (idx % returns)::INTEGER AS return_no, x_mm FROM packets p JOIN layout USING (data_type)""")
def p1_multi_return_split(spark, d):
    return p.split_returns(fx.packets(spark, d)).select("packet_no", "idx", "data_type", "raw_index", "return_no", "x_mm")


@query(f"WITH {fx.PACKETS} SELECT packet_no, idx, x_mm / 1000.0::DOUBLE AS x, y_mm / 1000.0::DOUBLE AS y, z_mm / 1000.0::DOUBLE AS z FROM packets")
def p2_millimetres(spark, d):
    return fx.packets(spark, d).select("packet_no", "idx", *(p.metres(F.col(f"{c}_mm")).alias(c) for c in XYZ))


@query(f"""WITH {fx.PACKETS}, s AS (SELECT packet_no, idx, abs(x_mm) / 1000.0::DOUBLE AS rr, radians((idx * 800 % 18000) / 100.0::DOUBLE) AS t, radians(((packet_no * 37 + idx * 1000) % 36000) / 100.0::DOUBLE) AS p FROM packets)
SELECT packet_no, idx, {sql_r("rr * sin(t) * cos(p)")} AS x, {sql_r("rr * sin(t) * sin(p)")} AS y, {sql_r("rr * cos(t)")} AS z FROM s""")
def p3_spherical(spark, d):
    x, y, z = p.from_spherical(F.abs("x_mm"), F.col("idx") * 800 % 18000, (F.col("packet_no") * 37 + F.col("idx") * 1000) % 36000)
    return fx.packets(spark, d).select("packet_no", "idx", r(x).alias("x"), r(y).alias("y"), r(z).alias("z"))


@query(f"""WITH {fx.PACKETS}, f AS (SELECT *, ts_ns // 50000000 AS frame, min(ts_ns) OVER (PARTITION BY ts_ns // 50000000) AS frame_ns FROM packets WHERE data_type <> 6)
SELECT packet_no, idx, frame, greatest(0, least(4294967295, ts_ns + idx * (CASE WHEN data_type IN (0, 1) THEN 10000 ELSE 4166 END) - frame_ns))::BIGINT AS offset_ns FROM f""")
def p4_point_time(spark, d):
    pk = fx.packets(spark, d).where("data_type <> 6").withColumn("frame", F.expr("ts_ns div 50000000"))
    starts = pk.groupBy("frame").agg(F.min("ts_ns").alias("frame_ns"))
    return pk.join(starts, "frame").select("packet_no", "idx", "frame", p.offset_ns(F.col("ts_ns"), F.col("idx"), F.col("data_type"), F.col("frame_ns")).alias("offset_ns"))


@query(f"WITH {fx.PTS} SELECT frame_id, idx, line, tag FROM pts WHERE line < 6 AND (tag & 48) IN (0, 16)")
def p5_line_and_tag(spark, d):
    return fx.pts(spark, d).where(p.good_line_tag(F.col("line"), F.col("tag"), 6)).select("frame_id", "idx", "line", "tag")


@query(f"WITH {fx.PTS} SELECT frame_id, idx, x, y, z FROM pts WHERE x*x + y*y + z*z > 16.0")
def p6_blind_zone(spark, d):
    return fx.pts(spark, d).where(p.beyond_blind(*(F.col(c) for c in XYZ), 4.0)).select("frame_id", "idx", *XYZ)


#: Every 11th point spoiled, in four ways.
_SPOILED = f"""{fx.PTS}, spoiled AS (SELECT frame_id, idx, CASE WHEN (frame_id * 21 + idx) % 11 = 0 THEN CASE ((frame_id * 21 + idx) // 11) % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN 2e6 ELSE -1e9 END ELSE x END AS x, y, z FROM pts)"""


def spoiled(spark, d):
    n = F.col("frame_id") * 21 + F.col("idx")
    kind = (F.floor(n / 11) % 4).cast("int")
    bad = F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf"))).when(kind == 2, F.lit(2e6)).otherwise(F.lit(-1e9))
    return fx.pts(spark, d).withColumn("x", F.when(n % 11 == 0, bad).otherwise(F.col("x")))


@query(f"WITH {_SPOILED} SELECT frame_id, idx FROM spoiled WHERE NOT isnan(x) AND abs(x) <= 1e6 AND abs(y) <= 1e6 AND abs(z) <= 1e6")
def p7_usable_points(spark, d):
    return spoiled(spark, d).where(p.usable(*(F.col(c) for c in XYZ))).select("frame_id", "idx")


@query(f"""WITH {_SPOILED}, k AS (SELECT *, CASE WHEN isnan(x) OR isinf(x) THEN 'invalid' WHEN abs(x) > 1e8 THEN 'overflow' ELSE 'ok' END AS reason FROM spoiled)
SELECT reason, count(*) AS n FROM k GROUP BY reason""")
def p8_invalid_split(spark, d):
    finite = ~F.isnan("x") & (F.abs("x") < float("inf"))
    reason = F.when(~finite, "invalid").when(F.abs("x") > 1e8, "overflow").otherwise("ok")
    return spoiled(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {fx.PACKETS} SELECT packet_no, idx, CASE WHEN idx % 5 = 0 THEN 100.0 ELSE reflectivity END::DOUBLE AS intensity, ((idx * 10000) / 1e6)::DOUBLE AS offset_ms FROM packets""")
def p9_field_mapping(spark, d):
    raw = fx.packets(spark, d).select("packet_no", "idx", F.when(F.col("idx") % 5 != 0, F.col("reflectivity")).alias("reflectivity"), (F.col("idx") * 10000).alias("offset_ns"))
    return p.mapped_fields(raw).select("packet_no", "idx", "intensity", "offset_ms")


_TILES = f"""{fx.PTS}, t AS (SELECT *, floor(x / 20.0)::INTEGER AS tx, floor(y / 20.0)::INTEGER AS ty, floor(z / 20.0)::INTEGER AS tz FROM pts),
tiled AS (SELECT *, floor((x - tx * 20.0) / 2.0)::INTEGER AS vx, floor((y - ty * 20.0) / 2.0)::INTEGER AS vy, floor((z - tz * 20.0) / 2.0)::INTEGER AS vz FROM t)"""


def tiled(spark, d):
    return v.tile_keys(fx.pts(spark, d), 20.0, 2.0)


@query(f"WITH {_TILES} SELECT frame_id, idx, tx, ty, tz, vx, vy, vz FROM tiled")
def p10_tile_keys(spark, d):
    return tiled(spark, d).select("frame_id", "idx", "tx", "ty", "tz", "vx", "vy", "vz")


@query(f"WITH {fx.PTS} SELECT frame_id, idx FROM pts WHERE x >= -5 AND x < 5 AND y >= -8 AND y < 2 AND z >= 0 AND z < 20")
def p12_box(spark, d):
    return fx.pts(spark, d).where(p.in_box(*(F.col(c) for c in XYZ), (-5, -8, 0), (5, 2, 20))).select("frame_id", "idx")


@query(f"""WITH {fx.PTS}, f AS (SELECT DISTINCT frame_id FROM pts), c AS (SELECT frame_id, count(*) AS n FROM pts WHERE line < 6 AND (tag & 48) IN (0, 16) AND idx < frame_id % 14 GROUP BY frame_id)
SELECT frame_id, coalesce(n, 0) AS n_points, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n < 5 THEN 'too_few_points' ELSE 'ok' END AS status FROM f LEFT JOIN c USING (frame_id)""")
def p13_frame_gates(spark, d):
    pts = fx.pts(spark, d)
    return p.frame_gates(pts, pts.where(p.good_line_tag(F.col("line"), F.col("tag"), 6) & (F.col("idx") < F.col("frame_id") % 14)))


def _clean_sql(stride: int, blind: float) -> str:
    """Spelled out from the scan rules, row by row: a counter over good rows, and the slot before each row."""
    return f"""{fx.PTS}, good AS (SELECT *, (idx >= 1 AND line < 6 AND (tag & 48) IN (0, 16)) AS ok FROM pts),
counted AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY frame_id ORDER BY idx) AS n FROM good),
written AS (SELECT *, ok AND n % {stride} = 0 AS w FROM counted),
slots AS (SELECT *, coalesce(lag(CASE WHEN w THEN x ELSE 0.0 END) OVER q, 0.0) AS lx, coalesce(lag(CASE WHEN w THEN y ELSE 0.0 END) OVER q, 0.0) AS ly,
    coalesce(lag(CASE WHEN w THEN z ELSE 0.0 END) OVER q, 0.0) AS lz FROM written WINDOW q AS (PARTITION BY frame_id ORDER BY idx)),
clean AS (SELECT frame_id, idx, x, y, z, intensity, offset_ms FROM slots WHERE w AND (abs(x - lx) > 1e-7 OR abs(y - ly) > 1e-7 OR abs(z - lz) > 1e-7) AND x*x + y*y + z*z > {blind * blind})"""


@query(f"WITH {_clean_sql(3, 0.0)} SELECT frame_id, idx FROM written WHERE w")
def w1_stride_sampling(spark, d):
    return p.strided(fx.pts(spark, d), 3).select("frame_id", "idx")


@query(f"WITH {_clean_sql(1, 0.0)} SELECT frame_id, idx FROM clean")
def w2_duplicate_removal(spark, d):
    return p.without_repeats(fx.pts(spark, d)).select("frame_id", "idx")


@query(f"WITH {_clean_sql(2, 4.0)} SELECT frame_id, idx, x, y, z FROM clean")
def w1_w2_clean_scan(spark, d):
    return p.cleaned(fx.pts(spark, d), 6, 2, 4.0).select("frame_id", "idx", *XYZ)


@query(f"""WITH {fx.PTS}, n AS (SELECT frame_id, idx, row_number() OVER (PARTITION BY frame_id ORDER BY idx) AS k FROM pts WHERE line < 6) SELECT frame_id, idx FROM n WHERE k <= 7""")
def o3_feature_cap(spark, d):
    return p.capped(fx.pts(spark, d).where("line < 6"), 7, [F.col("idx")]).select("frame_id", "idx")


@query(f"WITH {fx.PTS} SELECT frame_id, idx, (row_number() OVER (PARTITION BY frame_id ORDER BY (idx * 7) % 21 * 0.5, idx))::INTEGER AS place FROM pts")
def o2_points_by_offset(spark, d):
    from pyspark.sql import Window

    shuffled = fx.pts(spark, d).withColumn("offset_ms", (F.col("idx") * 7) % 21 * 0.5)
    return shuffled.select("frame_id", "idx", F.row_number().over(Window.partitionBy("frame_id").orderBy("offset_ms", "idx")).alias("place"))


@query(f"""WITH {fx.PACKETS}, k AS (SELECT packet_no, any_value(data_type) AS data_type, (count(*) - (packet_no % 4 = 1)::INTEGER) AS n_returns FROM packets GROUP BY packet_no)
SELECT count(*) FILTER (data_type > 8) AS unsupported, count(*) FILTER ((data_type IN (4, 5) AND n_returns % 2 <> 0) OR (data_type IN (7, 8) AND n_returns % 3 <> 0)) AS truncated, bool_or(data_type <> 6) AS seen_points, bool_or(data_type = 6) AS seen_imu FROM k""")
def a18_quality_counters(spark, d):
    n = fx.packets(spark, d).groupBy("packet_no", "data_type").agg((F.count(F.lit(1)) - (F.col("packet_no") % 4 == 1).cast("int")).alias("n_returns"))
    return p.quality_counters(n)


# -- voxels

_BIG_ORDER = "ord"
_ALL = "x, y, z, intensity"


@query(f"""WITH {fx.PTS_BIG}, k AS (SELECT *, floor(x / 2.0)::BIGINT AS gx, floor(y / 2.0)::BIGINT AS gy, floor(z / 2.0)::BIGINT AS gz FROM pts_big WHERE abs(x) <= 1e6 AND abs(y) <= 1e6 AND abs(z) <= 1e6),
n AS (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY ord) AS n FROM k) SELECT gx, gy, gz, {_ALL} FROM n WHERE n = 1""")
def a2_voxel_first(spark, d):
    return v.first_per_voxel(fx.pts_big(spark, d), 2.0, _BIG_ORDER)


@query(f"WITH {_SPOILED} SELECT frame_id, idx FROM spoiled WHERE NOT isnan(x) AND abs(x) <= 1e6")
def a2_voxel_pass_through(spark, d):
    return v.first_per_voxel(spoiled(spark, d), 0.0, F.col("idx"), ("frame_id", "idx"))


def _policy_sql(policy: str) -> str:
    keyed = f"{fx.PTS_BIG}, k AS (SELECT *, floor(x / 2.0)::BIGINT AS gx, floor(y / 2.0)::BIGINT AS gy, floor(z / 2.0)::BIGINT AS gz FROM pts_big)"
    if policy == "centroid":
        return f"WITH {keyed} SELECT gx, gy, gz, {', '.join(f'{sql_r(f'avg({c})', 10)} AS {c}' for c in ('x', 'y', 'z', 'intensity'))}, count(*) AS n FROM k GROUP BY gx, gy, gz"
    way = "" if policy == "first" else " DESC"
    return f"WITH {keyed}, o AS (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY ord{way}) AS rn, count(*) OVER (PARTITION BY gx, gy, gz) AS n FROM k) SELECT gx, gy, gz, {_ALL}, n FROM o WHERE rn = 1"


def _policy(policy):
    def run(spark, d):
        out = v.with_policy(v.voxel_keys(fx.pts_big(spark, d), 2.0), policy, _BIG_ORDER, ["gx", "gy", "gz"])
        return out.select("gx", "gy", "gz", *(r(F.col(c), 10).alias(c) for c in ("x", "y", "z", "intensity")), "n") if policy == "centroid" else out

    return run


for _p in v.POLICIES:
    query(_policy_sql(_p), f"a3_voxel_{_p}")(_policy(_p))


@query(f"""WITH {fx.PTS}, k AS (SELECT *, frame_id * 21 + idx AS ord, floor(x / 2.0)::BIGINT AS gx, floor(y / 2.0)::BIGINT AS gy, floor(z / 2.0)::BIGINT AS gz FROM pts),
e AS (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY pow(x - (gx + 0.5) * 2.0, 2) + pow(y - (gy + 0.5) * 2.0, 2) + pow(z - (gz + 0.5) * 2.0, 2), ord DESC) AS n FROM k)
SELECT gx, gy, gz, frame_id, idx FROM e WHERE n = 1""")
def a4_nearest_to_centre(spark, d):
    return v.nearest_centre(fx.pts(spark, d), 2.0, F.col("frame_id") * 21 + F.col("idx"), ("frame_id", "idx"))


@query(f"""WITH {fx.PTS_BIG}, k AS (SELECT *, floor(x / 2.0)::BIGINT AS gx, floor(y / 2.0)::BIGINT AS gy, floor(z / 2.0)::BIGINT AS gz FROM pts_big),
fine AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY ord) AS n FROM k) WHERE n = 1),
again AS (SELECT x, y, z, intensity, ord, floor(x / 8.0)::BIGINT AS gx, floor(y / 8.0)::BIGINT AS gy, floor(z / 8.0)::BIGINT AS gz FROM fine)
SELECT gx, gy, gz, {_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY ord) AS n FROM again) WHERE n = 1""")
def a5_coarse_snapshot(spark, d):
    fine = v.first_per_voxel(fx.pts_big(spark, d), 2.0, _BIG_ORDER, ("x", "y", "z", "intensity", "ord")).drop("gx", "gy", "gz")
    return v.snapshot(fine, 2.0, 8.0, _BIG_ORDER)


@query(f"WITH {fx.PTS_BIG} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pts_big")
def a6_bounding_box(spark, d):
    return v.bounding_box(fx.pts_big(spark, d))


@query(f"WITH {fx.PTS} SELECT count(*) AS n_points, count(*) FILTER (NOT (tag % 7 = 3)) AS n_valid, {sql_r('count(*) FILTER (tag % 7 = 3) / count(*)::DOUBLE', 9)} AS deleted_share FROM pts")
def a7_sizes(spark, d):
    return v.sizes(fx.pts(spark, d).withColumn("deleted", F.col("tag") % 7 == 3)).withColumn("deleted_share", r(F.col("deleted_share"), 9))


@query(f"""WITH {_SPOILED}, k AS (SELECT *, CASE WHEN isnan(x) OR isinf(x) THEN 'invalid' WHEN abs(x) > 1e6 THEN 'range' ELSE 'ok' END AS kind FROM spoiled),
c AS (SELECT count(DISTINCT (floor(x / 2.0)::BIGINT, floor(y / 2.0)::BIGINT, floor(z / 2.0)::BIGINT)) AS opened, count(*) AS n FROM k WHERE kind = 'ok')
SELECT (SELECT count(*) FROM k) AS observed, opened AS inserted, n - opened AS updated, (SELECT count(*) FROM k WHERE kind = 'invalid') AS rejected_invalid, (SELECT count(*) FROM k WHERE kind = 'range') AS rejected_range, (SELECT count(*) FROM k WHERE kind <> 'ok') > 0 AS incomplete FROM c""")
def a9_map_statistics(spark, d):
    return v.map_statistics(spoiled(spark, d), 2.0)


@query(f"""WITH {fx.PTS}, k AS (SELECT frame_id, idx, floor(x / 2.0)::BIGINT AS gx, floor(y / 2.0)::BIGINT AS gy, floor(z / 2.0)::BIGINT AS gz FROM pts)
SELECT frame_id, idx, gx, gy, gz FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY frame_id, idx) AS n FROM k) WHERE n = 1""")
def w7_new_voxel_delta(spark, d):
    return v.new_voxels(fx.pts(spark, d), 2.0, [F.col("frame_id"), F.col("idx")]).select("frame_id", "idx", "gx", "gy", "gz")


@query(f"""WITH {fx.PTS}, u AS (SELECT frame_id, idx, x, 'point' AS kind FROM pts UNION ALL SELECT event_id, NULL, value, 'imu' FROM events WHERE event_type NOT IN ('view', 'click'))
SELECT kind, count(*) AS n, {sql_r('sum(x)', 4)} AS total FROM u GROUP BY kind""")
def u1_merge_streams(spark, d):
    points = fx.pts(spark, d).select("frame_id", "idx", "x", F.lit("point").alias("kind"))
    samples = fx.imu(spark, d).select(F.col("seq").alias("frame_id"), F.lit(None).cast("int").alias("idx"), F.col("ax").alias("x"), F.lit("imu").alias("kind"))
    return points.unionByName(samples).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), 4).alias("total"))


# -- scalar functions

@query(f"""WITH {fx.PTS}, n AS (SELECT frame_id, idx, x, y, z, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz FROM pts WINDOW w AS (PARTITION BY frame_id ORDER BY idx))
SELECT frame_id, idx, {sql_r("sqrt(x*x + y*y + z*z)")} AS norm, {sql_r("sqrt(x*x + y*y)")} AS range_xy, {sql_r("pow(x-bx, 2) + pow(y-by_, 2) + pow(z-bz, 2)")} AS d2,
{sql_r("x*bx + y*by_ + z*bz")} AS dot, {sql_r("y*bz - z*by_")} AS cx, {sql_r("z*bx - x*bz")} AS cy, {sql_r("x*by_ - y*bx")} AS cz, {sql_r("(x*bx + y*by_ + z*bz) / sqrt(x*x + y*y + z*z) / sqrt(bx*bx + by_*by_ + bz*bz)")} AS cosine FROM n WHERE bx IS NOT NULL""")
def f1_f3_vectors(spark, d):
    from pyspark.sql import Window

    scan = Window.partitionBy("frame_id").orderBy("idx")
    n = fx.pts(spark, d).select("frame_id", "idx", *XYZ, *(F.lead(c).over(scan).alias(f"b{c}") for c in XYZ)).where("bx IS NOT NULL")
    a, b = [F.col(c) for c in XYZ], [F.col(f"b{c}") for c in XYZ]
    return n.select("frame_id", "idx", r(g.norm(a)).alias("norm"), r(F.sqrt(a[0] * a[0] + a[1] * a[1])).alias("range_xy"), r(g.squared_distance(a, b)).alias("d2"), r(g.dot(a, b)).alias("dot"), *(r(c).alias(f"c{k}") for c, k in zip(g.cross(a, b), XYZ, strict=True)), r(g.cosine(a, b)).alias("cosine"))


@query(f"""WITH {fx.PTS} SELECT frame_id, idx, {sql_r("x * (180.0 / 3.14159265358)", 5)} AS deg, {sql_r("x * (3.14159265358 / 180.0)", 9)} AS rad, {sql_r("x * 9.80665")} AS metric_acc FROM pts""")
def f2_f12_units(spark, d):
    from pointloom.operators import motion

    x = F.col("x")
    return fx.pts(spark, d).select("frame_id", "idx", r(g.degrees(x), 5).alias("deg"), r(g.radians(x), 9).alias("rad"), r(motion.from_g(x)).alias("metric_acc"))


@query("""SELECT event_id, epoch_us(ts) // 1000000 AS sec, (epoch_us(ts) % 1000000) * 1000 AS nsec, epoch_us(ts) * 1000 AS ns FROM events""")
def f14_ros_time(spark, d):
    ns = fx.micros(F.col("ts")) * 1000
    sec, nsec = g.ns_parts(ns)
    return fx.table(spark, d, "events").select("event_id", sec.alias("sec"), nsec.alias("nsec"), ns.alias("ns"))


@query(f"""WITH {_SPOILED} SELECT frame_id, idx, (CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE greatest(0, least(255, round(greatest(-1.0, least(256.0, x * 8)))))::INTEGER END)::INTEGER AS byte FROM spoiled""")
def f15_clamp_u8(spark, d):
    return spoiled(spark, d).select("frame_id", "idx", g.clamp_u8(F.col("x") * 8).alias("byte"))


@query(f"""WITH {fx.PTS}, n AS (SELECT frame_id, idx, greatest(0.0, least(1.0, intensity / 255.0)) AS n FROM pts)
SELECT frame_id, idx, {sql_r("n")} AS red, {sql_r("0.35 + 0.45 * n")} AS green, {sql_r("1.0 - 0.65 * n")} AS blue, 0.9::DOUBLE AS alpha FROM n""")
def f16_intensity_colour(spark, d):
    red, green, blue, alpha = g.intensity_colour(F.col("intensity"))
    return fx.pts(spark, d).select("frame_id", "idx", r(red).alias("red"), r(green).alias("green"), r(blue).alias("blue"), alpha.alias("alpha"))


@query(f"WITH {_TILES} SELECT DISTINCT 'tile/' || tx || '/' || ty || '/' || tz AS tile_id, tx || ',' || ty || ',' || tz AS tile_key FROM tiled")
def f17_tile_ids(spark, d):
    keys = [F.col(c) for c in ("tx", "ty", "tz")]
    return tiled(spark, d).select(tx.tile_id(*keys).alias("tile_id"), tx.tile_key(*keys).alias("tile_key")).distinct()


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'unknown' ELSE regexp_replace(substr(event_type || ' ' || repeat('=x', (event_id % 200)::INTEGER), 1, 255), '[^A-Za-z0-9._:/-]', '_', 'g') END AS token FROM events""")
def f19_log_tokens(spark, d):
    raw = F.concat("event_type", F.lit(" "), F.expr("repeat('=x', cast(event_id % 200 as int))"))
    return fx.table(spark, d, "events").select("event_id", tx.log_token(F.when(F.col("event_id") % 13 != 0, raw).otherwise("")).alias("token"))


@query(f"""WITH {_TILES}, n AS (SELECT tx, ty, tz, count(*) AS n FROM tiled GROUP BY tx, ty, tz) SELECT tx, ty, tz, n * 256 AS bytes, greatest(0, floor((n * 100) / 256.0))::BIGINT AS points FROM n""")
def f21_tile_bytes(spark, d):
    n = tiled(spark, d).groupBy("tx", "ty", "tz").agg(F.count(F.lit(1)).alias("n"))
    return n.select("tx", "ty", "tz", tx.tile_bytes(F.col("n")).alias("bytes"), tx.points_for_bytes(F.col("n") * 100).alias("points"))
