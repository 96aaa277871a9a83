"""Queries on spatial joins, scan matching, the tiled map, exports' chunking, and pipeline metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pointloom import fixtures as fx
from pointloom.functions import geometry as g
from pointloom.functions import text as tx
from pointloom.operators import knn, matching, metrics, spatial, tiles
from pointloom.operators import voxels as v
from pointloom.plans.cloud import _TILES, tiled
from pointloom.plans.registry import query, r, sql_r

XYZ = ("x", "y", "z")
_PT = f"{fx.PTS}, p AS (SELECT frame_id * 21 + idx AS point_id, x, y, z FROM pts), q AS (SELECT point_id AS query_id, x AS qx, y AS qy, z AS qz FROM p WHERE point_id % 20 = 0)"
_D2 = "(pow(x - qx, 2) + pow(y - qy, 2) + pow(z - qz, 2))"


def _points(spark, d):
    return fx.pts(spark, d).select((F.col("frame_id") * 21 + F.col("idx")).alias("point_id"), "frame_id", "idx", *XYZ)


def _queries(spark, d):
    """The searches' stated queries: points whose id is divisible by 20, against all points."""
    return _points(spark, d).where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "frame_id", *(F.col(c).alias(f"q{c}") for c in XYZ))


@query(f"""WITH {_PT}, m AS (SELECT query_id, point_id, {_D2} AS d2 FROM q JOIN p ON abs(x - qx) <= 2.2361 AND abs(y - qy) <= 2.2361 AND abs(z - qz) <= 2.2361), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM m WHERE d2 <= 5.0)
SELECT query_id, rank::INTEGER AS rank, point_id, {sql_r('d2')} AS d2 FROM n WHERE rank <= 5 AND n >= 5""")
def j4_nearest_join(spark, d):
    return spatial.nearest_join(_queries(spark, d), _points(spark, d)).withColumn("d2", r(F.col("d2")))


@query(f"""WITH {fx.PTS}, p AS (SELECT frame_id * 21 + idx AS point_id, x, y, z FROM pts), q AS (SELECT point_id AS query_id, CASE WHEN point_id % 40 = 0 THEN x * 3 ELSE x END AS qx, CASE WHEN point_id % 40 = 0 THEN y * 3 ELSE y END AS qy, z AS qz FROM p WHERE point_id % 20 = 0),
m AS (SELECT query_id, point_id, {_D2} AS d2 FROM q, p), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS rank FROM m) SELECT query_id, rank::INTEGER AS rank, point_id, {sql_r('d2')} AS d2 FROM n WHERE rank <= 5""")
def j4_nearest_ungated(spark, d):
    """The five nearest however far: every second query stands at three times its distance, in emptier space."""
    away = F.when(F.col("query_id") % 40 == 0, 3.0).otherwise(1.0)
    asked = _queries(spark, d).withColumn("qx", F.col("qx") * away).withColumn("qy", F.col("qy") * away)
    return knn.nearest(asked, _points(spark, d)).withColumn("d2", r(F.col("d2")))


@query(f"WITH {_PT} SELECT query_id, point_id, {sql_r(_D2)} AS d2 FROM q JOIN p ON {_D2} <= 9.0")
def j5_radius_join(spark, d):
    return spatial.radius_join(_queries(spark, d), _points(spark, d), 3.0).withColumn("d2", r(F.col("d2")))


_BOX = f"{_PT}, boxes AS (SELECT query_id AS box_id, qx - 2 AS min_x, qx + 3 AS max_x, qy - 1 AS min_y, qy + 4 AS max_y, qz - 2.5 AS min_z, qz + 2.5 AS max_z FROM q), hits AS (SELECT box_id, point_id FROM boxes JOIN p ON x >= min_x AND x < max_x AND y >= min_y AND y < max_y AND z >= min_z AND z < max_z)"


def _boxes(spark, d):
    return _queries(spark, d).select(F.col("query_id").alias("box_id"), (F.col("qx") - 2).alias("min_x"), (F.col("qx") + 3).alias("max_x"), (F.col("qy") - 1).alias("min_y"), (F.col("qy") + 4).alias("max_y"), (F.col("qz") - 2.5).alias("min_z"), (F.col("qz") + 2.5).alias("max_z"))


@query(f"WITH {_BOX} SELECT box_id, point_id FROM hits")
def j6_box_join(spark, d):
    return spatial.box_join(_boxes(spark, d), _points(spark, d), 5.0)


@query(f"WITH {_BOX} SELECT point_id FROM p WHERE point_id NOT IN (SELECT point_id FROM hits)")
def j9_delete_in_boxes(spark, d):
    return spatial.delete_in_boxes(_points(spark, d), _boxes(spark, d), 5.0).select("point_id")


@query(f"WITH {_PT} SELECT point_id FROM p WHERE point_id % 20 <> 0")
def j9_delete_matching(spark, d):
    """Points that stand within 1e-6 of one of every 20 points, moved by 4e-7, go."""
    marks = _queries(spark, d).select((F.col("qx") + 4e-7).alias("x"), (F.col("qy") - 4e-7).alias("y"), F.col("qz").alias("z"))
    return spatial.delete_matching(_points(spark, d), marks).select("point_id")


@query(f"WITH {_BOX} SELECT point_id, point_id % 3 = 0 AND point_id NOT IN (SELECT point_id FROM hits) AS deleted FROM p")
def j10_restore_in_boxes(spark, d):
    marked = _points(spark, d).withColumn("deleted", F.col("point_id") % 3 == 0)
    return spatial.restore_in_boxes(marked, _boxes(spark, d), 5.0).select("point_id", "deleted")


@query(f"WITH {_PT} SELECT point_id FROM p WHERE point_id % 3 = 0 AND point_id % 2 = 0")
def u3_removed_changelog(spark, d):
    marked = _points(spark, d).withColumn("deleted", F.col("point_id") % 3 == 0).withColumn("cause", F.when(F.col("point_id") % 2 == 1, "downsample"))
    return spatial.removed(marked).select("point_id")


@query(f"WITH {_PT} SELECT x, y, z FROM p EXCEPT ALL SELECT x, y, z FROM p WHERE point_id % 3 = 0")
def u2_map_difference(spark, d):
    points = _points(spark, d)
    return points.select(*XYZ).exceptAll(points.where("point_id % 3 = 0").select(*XYZ))


@query(f"WITH {_PT} SELECT point_id FROM p WHERE x >= -8 AND x < 12 AND y >= -12 AND y < 8 AND z >= -10 AND z < 10")
def o11_local_map_trim(spark, d):
    return spatial.trimmed(_points(spark, d), (F.lit(2.0), F.lit(-2.0), F.lit(0.0)), 10.0).select("point_id")


# -- matching: all points of every frame, against the whole map

_ALL = f"{fx.PTS}, p AS (SELECT frame_id * 21 + idx AS point_id, frame_id, x, y, z FROM pts)"
_SIDE = 2.23606797749979  # fixed value: the root of 5
_FIT = f"""{_ALL}, c AS (SELECT *, floor(x / {_SIDE})::BIGINT AS cx, floor(y / {_SIDE})::BIGINT AS cy, floor(z / {_SIDE})::BIGINT AS cz FROM p),
q AS (SELECT point_id AS query_id, x AS qx, y AS qy, z AS qz, cx + a AS cx, cy + b AS cy, cz + e AS cz FROM c, range(-1, 2) r1(a), range(-1, 2) r2(b), range(-1, 2) r3(e)),
m AS (SELECT query_id, point_id, x, y, z, {_D2} AS d2 FROM q JOIN c USING (cx, cy, cz) WHERE {_D2} <= 5.0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, point_id) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM m) WHERE k <= 5 AND n >= 5),
s AS (SELECT query_id, sum(x*x) AS xx, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*y) AS yy, sum(y*z) AS yz, sum(z*z) AS zz, -sum(x) AS bx, -sum(y) AS by_, -sum(z) AS bz FROM n GROUP BY query_id),
d AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM s),
v AS (SELECT query_id, (bx * (yy * zz - yz * yz) - xy * (by_ * zz - yz * bz) + xz * (by_ * yz - yy * bz)) / det AS n0, (xx * (by_ * zz - yz * bz) - bx * (xy * zz - yz * xz) + xz * (xy * bz - by_ * xz)) / det AS n1,
    (xx * (yy * bz - by_ * yz) - xy * (xy * bz - by_ * xz) + bx * (xy * yz - yy * xz)) / det AS n2 FROM d WHERE abs(det) > 1e-12),
u AS (SELECT query_id, n0 / sqrt(n0*n0 + n1*n1 + n2*n2) AS a, n1 / sqrt(n0*n0 + n1*n1 + n2*n2) AS b, n2 / sqrt(n0*n0 + n1*n1 + n2*n2) AS c, 1 / sqrt(n0*n0 + n1*n1 + n2*n2) AS d FROM v),
w AS (SELECT query_id, max(abs(a * x + b * y + c * z + d)) AS worst FROM n JOIN u USING (query_id) GROUP BY query_id),
fits AS (SELECT s.query_id, a, b, c, d, worst, coalesce(worst <= 0.1, false) AS accepted FROM s LEFT JOIN u USING (query_id) LEFT JOIN w USING (query_id))"""
_MATCH = f"""{_FIT}, res AS (SELECT point_id AS query_id, frame_id, x, y, z, a, b, c, a * x + b * y + c * z + d AS residual, sqrt(x*x + y*y + z*z) + 25.0 AS norm FROM p JOIN fits ON query_id = point_id WHERE accepted),
matched AS (SELECT * FROM res WHERE norm > 0 AND 1 - 0.9 * abs(residual) / sqrt(norm) > 0.9)"""


def _scan(spark, d):
    """Every point as a query."""
    return _points(spark, d).select(F.col("point_id").alias("query_id"), "frame_id", *(F.col(c).alias(f"q{c}") for c in XYZ))


def _fits(spark, d):
    """The plane of the five nearest points of each point, in the whole map."""
    q = _scan(spark, d).withColumn("body_norm", F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2) + 25.0)
    return matching.planes(spatial.nearest_lists(q, _points(spark, d), keep=("frame_id", "body_norm")))


def _matched(spark, d):
    return matching.residuals(_fits(spark, d))


@query(f"WITH {_FIT} SELECT query_id, accepted, CASE WHEN accepted THEN {sql_r('worst', 5)} END AS worst, CASE WHEN accepted THEN {sql_r('d', 4)} END AS d FROM fits")
def a11_plane_fits(spark, d):
    return _fits(spark, d).select("query_id", "accepted", *(F.when(F.col("accepted"), r(F.col(c), n)).alias(c) for c, n in (("worst", 5), ("d", 4))))


@query(f"WITH {_ALL}, s AS (SELECT point_id AS query_id, x / 10 AS residual, sqrt(x*x + y*y + z*z) AS norm FROM p) SELECT query_id FROM s WHERE norm > 0 AND 1 - 0.9 * abs(residual) / sqrt(norm) > 0.9")
def p14_residual_gate(spark, d):
    q = _scan(spark, d)
    return q.where(matching.residual_accepted(F.col("qx") / 10, F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2))).select("query_id")


@query(f"WITH {_MATCH} SELECT frame_id, count(*) AS effective, {sql_r('sum(abs(residual))')} AS total_residual, {sql_r('avg(abs(residual))')} AS mean_residual FROM matched GROUP BY frame_id")
def a12_match_report(spark, d):
    found = matching.match_report(_matched(spark, d))
    return found.select("frame_id", "effective", *(r(F.col(c)).alias(c) for c in ("total_residual", "mean_residual")))


#: A frame's heading, and where the sensor sits in the body.
_YAW, _MOUNT = "(frame_id % 7) * 0.1", (0.3, -0.2, 0.1)


def _normal_equations(spark, d):
    """Each frame turned by its heading: world points back into the sensor, and through the mount into the body."""
    m = _matched(spark, d)
    turn = g.rotation_z((F.col("frame_id") % 7) * 0.1)
    body = [c + o for c, o in zip(g.apply(g.transpose(turn), [F.col(f"q{c}") for c in XYZ]), (F.lit(o) for o in _MOUNT), strict=True)]
    return matching.normal_equations(m, matching.jacobian([F.col(c) for c in "abc"], body, turn))


_ROWS = f"""{_MATCH}, t AS (SELECT *, cos({_YAW}) AS co, sin({_YAW}) AS si FROM matched), b AS (SELECT *, co * x + si * y + {_MOUNT[0]} AS px, -si * x + co * y + {_MOUNT[1]} AS py, z + {_MOUNT[2]} AS pz, co * a + si * b AS ra, -si * a + co * b AS rb, c AS rc FROM t),
rows_ AS (SELECT frame_id, residual, a AS j0, b AS j1, c AS j2, py * rc - pz * rb AS j3, pz * ra - px * rc AS j4, px * rb - py * ra AS j5 FROM b)"""
_SUMS = ", ".join([f"{sql_r(f'sum(j{i} * j{k})', 5)} AS h_{i}{k}" for i in range(6) for k in range(i, 6)] + [f"{sql_r(f'sum(-j{i} * residual)', 5)} AS g_{i}" for i in range(6)])


@query(f"WITH {_ROWS} SELECT frame_id, {_SUMS}, count(*) AS n FROM rows_ GROUP BY frame_id")
def a13_normal_equations(spark, d):
    found = _normal_equations(spark, d)
    return found.select("frame_id", *(r(F.col(c), 5).alias(c) for c in found.columns if c[:2] in ("h_", "g_")), "n")


@query()
def a13_gauss_newton_step(spark, d):
    """The step that the equations give; the solving itself is tested on known systems."""
    return matching.solved(_normal_equations(spark, d))


@query(f"""WITH {_ALL} SELECT point_id AS query_id, {', '.join(f'{sql_r(e, 8)} AS j{i}' for i, e in enumerate(('0.6', '0.0', '0.8', 'y * 0.8', 'z * 0.6 - x * 0.8', '-y * 0.6')))} FROM p""")
def f22_jacobian_rows(spark, d):
    rows = matching.jacobian([F.lit(0.6), F.lit(0.0), F.lit(0.8)], [F.col(f"q{c}") for c in XYZ], g.identity())
    return _scan(spark, d).select("query_id", *(r(c, 8).alias(f"j{i}") for i, c in enumerate(rows)))


# -- the tiled map

_VERSIONS = """ch AS (SELECT DISTINCT tx, ty, tz, frame_id FROM {rows}), ver AS (SELECT *, dense_rank() OVER (PARTITION BY tx, ty, tz ORDER BY frame_id) AS version FROM ch)"""
_OPENED = f"{_TILES}, opened AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz, vx, vy, vz ORDER BY frame_id, idx) AS n FROM tiled) WHERE n = 1)"
_ORDER = ["frame_id", "idx"]


def _summary_sql(rows: str) -> str:
    return f"""WITH {_OPENED}, {_VERSIONS.format(rows=rows)}, c AS (SELECT tx, ty, tz, count(DISTINCT (vx, vy, vz)) AS n_voxels, count(*)::BIGINT AS n_points FROM tiled GROUP BY tx, ty, tz),
    m AS (SELECT tx, ty, tz, max(version) AS version, max(frame_id) AS last_frame FROM ver GROUP BY tx, ty, tz) SELECT tx, ty, tz, n_voxels, n_points, version, last_frame FROM c JOIN m USING (tx, ty, tz)"""


@query(_summary_sql("opened"))
def a8_tile_summary_first(spark, d):
    return tiles.summary(tiled(spark, d), "first", _ORDER)


@query(_summary_sql("tiled"))
def a8_tile_summary_latest(spark, d):
    return tiles.summary(tiled(spark, d), "latest", _ORDER)


@query(f"WITH {_OPENED}, {_VERSIONS.format(rows='opened')} SELECT tx, ty, tz, frame_id, version FROM ver")
def w11_tile_versions(spark, d):
    return tiles.versions(tiles.changes(tiled(spark, d), "first", _ORDER))


@query(f"WITH {_TILES} SELECT frame_id, count(DISTINCT (tx, ty, tz)) AS changed FROM tiled GROUP BY frame_id")
def a17_changed_tiles(spark, d):
    return tiled(spark, d).select("frame_id", *tiles.TILE).distinct().groupBy("frame_id").agg(F.count(F.lit(1)).alias("changed"))


_DELIVERED = "del AS (SELECT tx, ty, tz, max(version) - (tx + ty + tz) % 2 * (tx + ty + tz) % 2 AS version FROM ver WHERE NOT (tx = 0 AND ty = 0) GROUP BY tx, ty, tz)"


def _delivered(t):
    now = tiles.versions(tiles.changes(t, "latest", _ORDER)).groupBy(*tiles.TILE).agg(F.max("version").alias("version"))
    odd = (F.col("tx") + F.col("ty") + F.col("tz")) % 2
    return now.where("NOT (tx = 0 AND ty = 0)").withColumn("version", F.col("version") - odd * odd)


@query(f"""WITH {_TILES}, {_VERSIONS.format(rows='tiled')}, m AS (SELECT tx, ty, tz, max(version) AS version FROM ver GROUP BY tx, ty, tz)
SELECT t.tx, t.ty, t.tz, count(*) AS n FROM tiled t JOIN m USING (tx, ty, tz) WHERE (t.tx = 0 AND t.ty = 0) OR (t.tx + t.ty + t.tz) % 2 <> 0 GROUP BY t.tx, t.ty, t.tz""")
def j8_dirty_tiles(spark, d):
    t = tiled(spark, d)
    return tiles.dirty(t, _delivered(t)).groupBy(*tiles.TILE).agg(F.count(F.lit(1)).alias("n"))


_CHANGED = f"""{_TILES}, n AS (SELECT frame_id % 4 AS map_id, tx, ty, tz, count(*) AS n_points, max(frame_id * 21 + idx) AS seq FROM tiled GROUP BY 1, 2, 3, 4), changed AS (SELECT map_id, seq, tx, ty, tz, seq % 5 = 0 AS deleted, n_points, CASE WHEN seq % 5 = 0 THEN 100 + seq % 4 * 150000 ELSE n_points * 256 END AS n_bytes FROM n)"""


def _changed(spark, d):
    n = tiled(spark, d).groupBy((F.col("frame_id") % 4).alias("map_id"), *tiles.TILE).agg(F.count(F.lit(1)).alias("n_points"), F.max(F.col("frame_id") * 21 + F.col("idx")).alias("seq"))
    return n.select("map_id", "seq", *tiles.TILE, (F.col("seq") % 5 == 0).alias("deleted"), "n_points", F.when(F.col("seq") % 5 == 0, 100 + F.col("seq") % 4 * 150_000).otherwise(F.col("n_points") * 256).cast("bigint").alias("n_bytes"))


def _batch_sql(tiles: int, points: int, size: int) -> str:
    """Row by row: deletions first, then live tiles; 0 is no bound."""
    fits = " AND ".join(["NOT s.closed", *([f"s.tiles < {tiles}"] * bool(tiles)), *([f"s.points + CASE WHEN o.deleted THEN 0 ELSE o.n_points END <= {points}"] * bool(points)), *([f"s.bytes + o.n_bytes <= {size}"] * bool(size))])
    return f"""WITH RECURSIVE {_CHANGED}, o AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY deleted DESC, seq) AS k FROM changed),
s AS (SELECT DISTINCT map_id, 0::BIGINT AS k, 0::BIGINT AS tiles, 0::BIGINT AS points, 0::BIGINT AS bytes, false AS closed, false AS taken FROM o
UNION ALL SELECT map_id, k, tiles + t::INTEGER, points + CASE WHEN t AND NOT deleted THEN n_points ELSE 0 END, bytes + CASE WHEN t THEN n_bytes ELSE 0 END, closed OR NOT (t OR deleted), t
    FROM (SELECT s.map_id, o.k, s.tiles, s.points, s.bytes, s.closed, o.deleted, o.n_points, o.n_bytes, {fits} AS t FROM s JOIN o ON o.map_id = s.map_id AND o.k = s.k + 1))
SELECT o.map_id, o.seq, o.deleted, o.n_points FROM o JOIN s USING (map_id, k) WHERE s.taken"""


@query(_batch_sql(6, 3000, 600_000))
def o5_bounded_batch(spark, d):
    return tiles.bounded_batch(_changed(spark, d), 6, 3000, 600_000).select("map_id", "seq", "deleted", "n_points")


@query(_batch_sql(0, 0, 2_000_000))
def o5_batch_by_bytes(spark, d):
    return tiles.bounded_batch(_changed(spark, d), 0, 0, 2_000_000).select("map_id", "seq", "deleted", "n_points")


@query(f"""WITH {_TILES}, f AS (SELECT tx, ty, tz, vx, vy, vz, min(frame_id * 21 + idx) AS first FROM tiled GROUP BY ALL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz ORDER BY first) AS n FROM f) WHERE n <= 40)
SELECT frame_id, idx FROM tiled t JOIN k USING (tx, ty, tz, vx, vy, vz)""")
def o6_voxel_cap(spark, d):
    return tiles.voxel_cap(tiled(spark, d), 40, _ORDER).select("frame_id", "idx")


@query(f"""WITH {_TILES}, m AS (SELECT *, frame_id % 4 AS map_id FROM tiled), f AS (SELECT map_id, tx, ty, tz, vx, vy, vz, min(frame_id * 21 + idx) AS first FROM m GROUP BY ALL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY first) AS n FROM f) WHERE n <= 300)
SELECT frame_id, idx FROM m JOIN k USING (map_id, tx, ty, tz, vx, vy, vz)""")
def o9_stop_accumulating(spark, d):
    return tiles.stop_accumulating(tiled(spark, d).withColumn("map_id", F.col("frame_id") % 4), 300, _ORDER).select("frame_id", "idx")


_KEPT = f"""{_TILES}, m AS (SELECT *, frame_id % 4 AS map_id FROM tiled), s AS (SELECT map_id, tx, ty, tz, max(frame_id) AS last_frame, count(DISTINCT (vx, vy, vz))::BIGINT AS n_voxels FROM m GROUP BY map_id, tx, ty, tz)"""


def _map_tiles(spark, d):
    m = tiled(spark, d).withColumn("map_id", F.col("frame_id") % 4)
    cells = m.groupBy("map_id", *tiles.TILE, *tiles.VOXEL).agg(F.max("frame_id").alias("last"))
    return cells.groupBy("map_id", *tiles.TILE).agg(F.max("last").alias("last_frame"), F.count(F.lit(1)).alias("n_voxels"))


@query(f"WITH {_KEPT}, c AS (SELECT *, sum(n_voxels) OVER (PARTITION BY map_id ORDER BY last_frame DESC, tx, ty, tz ROWS UNBOUNDED PRECEDING) AS t FROM s) SELECT map_id, tx, ty, tz, last_frame, n_voxels FROM c WHERE t <= 500")
def o7_retain_lru(spark, d):
    return tiles.retain_lru(_map_tiles(spark, d), 500).select("map_id", *tiles.TILE, "last_frame", "n_voxels")


@query(f"""WITH {_KEPT}, e AS (SELECT *, pow((tx + 0.5) * 20.0 - 3, 2) + pow((ty + 0.5) * 20.0 + 4, 2) + pow((tz + 0.5) * 20.0 - 1, 2) AS d2 FROM s), c AS (SELECT *, sum(n_voxels) OVER (PARTITION BY map_id ORDER BY d2, last_frame DESC, tx, ty, tz ROWS UNBOUNDED PRECEDING) AS t FROM e)
SELECT map_id, tx, ty, tz, n_voxels FROM c WHERE t <= 500""")
def o8_evict_far(spark, d):
    return tiles.retain_near(_map_tiles(spark, d), 500, 20.0, (F.lit(3.0), F.lit(-4.0), F.lit(1.0))).select("map_id", *tiles.TILE, "n_voxels")


@query(f"WITH {_TILES}, n AS (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz ORDER BY frame_id DESC, idx DESC) AS k FROM tiled) SELECT frame_id, idx FROM n WHERE k <= 10")
def o10_drop_oldest(spark, d):
    return tiles.newest(tiled(spark, d), 10, tiles.TILE, _ORDER).select("frame_id", "idx")


@query(f"WITH {_TILES} SELECT tx, ty, tz, least(count(*), 10)::BIGINT AS kept, greatest(count(*) - 10, 0)::BIGINT AS dropped FROM tiled GROUP BY tx, ty, tz")
def o10_shedding_counts(spark, d):
    return tiles.shedding(tiled(spark, d), 10, tiles.TILE).select(*tiles.TILE, F.col("kept").cast("bigint").alias("kept"), "dropped")


_UPDATES = f"{_TILES}, {_VERSIONS.format(rows='tiled')}, upd AS (SELECT tx, ty, tz, least(version, 7) AS version, frame_id % 9 AS n_points, frame_id % 3 = 0 AS resync FROM ver)"


@query(f"WITH {_UPDATES}, g AS (SELECT tx, ty, tz, version, resync, max(n_points) AS n_points FROM upd GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz ORDER BY version DESC, resync DESC) AS k FROM g) SELECT tx, ty, tz, version, resync FROM n WHERE k = 1")
def t8_coalesced_updates(spark, d):
    ver = tiles.versions(tiles.changes(tiled(spark, d), "latest", _ORDER))
    upd = ver.select(*tiles.TILE, F.least("version", F.lit(7)).alias("version"), (F.col("frame_id") % 9).alias("n_points"), (F.col("frame_id") % 3 == 0).alias("resync"))
    return tiles.coalesced(upd).select(*tiles.TILE, "version", "resync")


@query(f"""WITH {_TILES}, {_VERSIONS.format(rows='tiled')}, m AS (SELECT tx, ty, tz, max(version) AS version FROM ver GROUP BY tx, ty, tz)
SELECT tx, ty, tz, greatest(version + 1, 4)::BIGINT AS version, true AS deleted FROM m WHERE NOT (tx = 0 AND ty = 0) AND tx < 0""")
def t9_tombstones(spark, d):
    t = tiled(spark, d)
    now = tiles.versions(tiles.changes(t, "latest", _ORDER)).groupBy(*tiles.TILE).agg(F.max("version").alias("version"))
    return tiles.tombstones(now.where("tx < 0"), _delivered(t), floor=3)


@query(f"WITH {_TILES}, {_VERSIONS.format(rows='tiled')} SELECT tx, ty, tz, max(version) AS version, true AS resync FROM ver GROUP BY tx, ty, tz")
def t10_full_resync(spark, d):
    now = tiles.versions(tiles.changes(tiled(spark, d), "latest", _ORDER)).groupBy(*tiles.TILE).agg(F.max("version").alias("version"))
    return tiles.resync(now)


@query(f"WITH {_TILES} SELECT tx, ty, tz, count(DISTINCT (vx, vy, vz)) AS n_voxels FROM tiled WHERE frame_id <= 250 GROUP BY tx, ty, tz")
def t11_barrier_snapshot(spark, d):
    up_to = tiled(spark, d).where(F.col("frame_id") <= 250)
    return up_to.select(*tiles.TILE, *tiles.VOXEL).distinct().groupBy(*tiles.TILE).agg(F.count(F.lit(1)).alias("n_voxels"))


_DELTA = f"""{fx.PTS}, k AS (SELECT frame_id, idx, floor(x / 2.0)::BIGINT AS gx, floor(y / 2.0)::BIGINT AS gy, floor(z / 2.0)::BIGINT AS gz FROM pts),
delta AS (SELECT frame_id % 4 AS map_id, frame_id, count(*) AS points FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY frame_id, idx) AS n FROM k) WHERE n = 1 GROUP BY frame_id)"""


@query(f"""WITH RECURSIVE {_DELTA}, n AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY frame_id) AS k FROM delta),
f AS (SELECT map_id, k, frame_id, points, points AS waiting, 0::BIGINT AS dropped, false AS resync FROM n WHERE k = 1
UNION ALL SELECT n.map_id, n.k, n.frame_id, n.points, CASE WHEN f.waiting > 0 AND f.waiting + n.points > 40 THEN n.points ELSE f.waiting + n.points END, CASE WHEN f.waiting > 0 AND f.waiting + n.points > 40 THEN f.waiting ELSE 0 END, f.waiting > 0 AND f.waiting + n.points > 40 FROM f JOIN n ON n.map_id = f.map_id AND n.k = f.k + 1)
SELECT map_id, frame_id, points, dropped, resync FROM f""")
def t12_delta_feed(spark, d):
    return tiles.delta_with_overflow(_deltas(spark, d), 40)


def _deltas(spark, d):
    fresh = v.new_voxels(fx.pts(spark, d), 2.0, [F.col("frame_id"), F.col("idx")])
    return fresh.groupBy((F.col("frame_id") % 4).alias("map_id"), "frame_id").agg(F.count(F.lit(1)).alias("points"))


@query(f"""WITH {_OPENED}, f AS (SELECT tx, ty, tz, min(x) AS min_x, max(x) AS max_x, count(*) AS n_voxels, count(DISTINCT frame_id) AS version FROM opened GROUP BY tx, ty, tz) SELECT tx, ty, tz, min_x, max_x, n_voxels, version FROM f""")
def tile_summary_first(spark, d):
    """The flagship: first point of each voxel, summed up by tile. The order of arrival is one number, so both aggregates
    hash, on both sides of their shuffles."""
    arrival = F.col("frame_id") * 32 + F.col("idx")
    cells = v.one_per_key(tiled(spark, d), [*tiles.TILE, *tiles.VOXEL], ("x", "y", "z", "intensity", "frame_id"), arrival)
    return cells.groupBy(*tiles.TILE).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.count(F.lit(1)).alias("n_voxels"), F.countDistinct("frame_id").alias("version"))


# -- metrics, chunks, logs

@query("""WITH s AS (SELECT event_type, event_id, CASE WHEN event_id % 50 = 0 THEN -1.0 WHEN event_id % 77 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS value FROM events), g AS (SELECT * FROM s WHERE value >= 0 AND NOT isinf(value)),
w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM g), l AS (SELECT * FROM w WHERE k <= 1024), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM l)
SELECT event_type, (SELECT count(*) FROM g WHERE g.event_type = o.event_type) AS total, count(*) AS in_window, round(avg(value), 9) AS average, min(value) FILTER (rk >= ceil(0.95 * n)) AS p95, min(value) FILTER (rk >= ceil(0.99 * n)) AS p99 FROM o GROUP BY event_type""")
def a14_timing_summary(spark, d):
    s = fx.table(spark, d, "events").select("event_type", "event_id", F.when(F.col("event_id") % 50 == 0, -1.0).when(F.col("event_id") % 77 == 0, float("inf")).otherwise(F.col("value")).alias("value"))
    return metrics.timing_summary(s, ["event_type"], "event_id", "value").withColumn("average", r(F.col("average"), 9))


@query("WITH g AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events WHERE value >= 1) SELECT event_type, event_id FROM g WHERE k <= 100")
def w6_last_samples(spark, d):
    s = fx.table(spark, d, "events").where("value >= 1").select("event_type", "event_id", "value")
    return metrics.last_samples(s, 100, ["event_type"], "event_id", "value").select("event_type", "event_id")


_LOG = "l AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'map_update' ELSE 'processed' END AS event, round(value, 2) AS total_ms, user_id AS points, event_type AS state FROM events)"


@query(f"WITH {_LOG} SELECT event_id, event, event_id AS frame, total_ms, points, state FROM l")
def f20_log_fields(spark, d):
    m = fx.log_lines(spark, d).select("event_id", tx.log_fields(F.col("line")).alias("m"))
    m_ = F.col("m")
    return m.select("event_id", tx.log_value(m_, "event", "string").alias("event"), tx.log_value(m_, "frame", "bigint").alias("frame"), tx.log_value(m_, "total_ms", "double").alias("total_ms"), tx.log_value(m_, "points", "bigint").alias("points"), tx.log_value(m_, "state", "string").alias("state"))


@query(f"WITH {_LOG} SELECT event, state, count(*) AS records, max(points) AS peak, count(*) FILTER (points > 500)::BIGINT AS over_limit, coalesce(sum(points) FILTER (points <= 500), 0)::BIGINT AS accepted FROM l GROUP BY event, state")
def a15_channel_counters(spark, d):
    m = fx.log_lines(spark, d).select(tx.log_fields(F.col("line")).alias("m"))
    rows = m.select(tx.log_value(F.col("m"), "event", "string").alias("event"), tx.log_value(F.col("m"), "state", "string").alias("state"), tx.log_value(F.col("m"), "points", "bigint").alias("points"))
    return metrics.channel_counters(rows, ["event", "state"], "points", 500).withColumnRenamed("over", "over_limit")


@query("SELECT event_id, greatest(100, ceil(2 * value))::BIGINT AS interval_ms FROM events")
def f23_publish_interval(spark, d):
    return fx.table(spark, d, "events").select("event_id", tx.publish_interval(F.lit(100), F.col("value")).alias("interval_ms"))


_CHUNK = "c AS (SELECT user_id % 8 AS recording_id, event_id, epoch_us(ts) AS ts_us, event_type, (row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1) // 100 AS chunk FROM events)"


def _chunks(spark, d):
    e = fx.table(spark, d, "events").select((F.col("user_id") % 8).alias("recording_id"), "event_id", fx.micros(F.col("ts")).alias("ts_us"), "event_type")
    return metrics.chunk_ids(e, 100, ["recording_id"], ["event_id"])


@query(f"WITH {_CHUNK} SELECT recording_id, event_id, chunk FROM c")
def w8_chunk_ids(spark, d):
    return _chunks(spark, d).select("recording_id", "event_id", "chunk")


@query(f"WITH {_CHUNK} SELECT recording_id, chunk, event_type, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS messages FROM c GROUP BY recording_id, chunk, event_type")
def a16_chunk_index(spark, d):
    return metrics.chunk_index(_chunks(spark, d), ["recording_id", "chunk", "event_type"], "ts_us")


@query(f"""WITH RECURSIVE {fx.PTS}, n AS (SELECT frame_id % 8 AS recording_id, frame_id, count(*) FILTER (idx <= frame_id % 21) AS n_points, row_number() OVER (PARTITION BY frame_id % 8 ORDER BY frame_id) AS k FROM pts GROUP BY frame_id),
f AS (SELECT recording_id, k, frame_id, n_points, 0::BIGINT AS chunk, (n_points >= 60) AS done, n_points::BIGINT AS p, 1 AS c FROM n WHERE k = 1
UNION ALL SELECT n.recording_id, n.k, n.frame_id, n.n_points, f.chunk + f.done::INTEGER, (CASE WHEN f.done THEN 0 ELSE f.p END + n.n_points >= 60) OR (CASE WHEN f.done THEN 0 ELSE f.c END + 1 >= 7), CASE WHEN f.done THEN 0 ELSE f.p END + n.n_points, CASE WHEN f.done THEN 0 ELSE f.c END + 1 FROM f JOIN n ON n.recording_id = f.recording_id AND n.k = f.k + 1)
SELECT recording_id, frame_id, n_points, chunk FROM f""")
def s8_frame_chunks(spark, d):
    frames = fx.pts(spark, d).groupBy((F.col("frame_id") % 8).alias("recording_id"), "frame_id").agg(F.count_if(F.col("idx") <= F.col("frame_id") % 21).alias("n_points"))
    return metrics.frame_chunks(frames, 60, 7, ["recording_id"])


@query(f"""WITH RECURSIVE {fx.POSES}, n AS (SELECT device, pose_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY device) AS total FROM poses WINDOW w AS (PARTITION BY device ORDER BY ts_us, pose_id)),
t AS (SELECT device, max(total) AS total FROM n GROUP BY device), h AS (SELECT device, total, 0::BIGINT AS i, 0::BIGINT AS held FROM t UNION ALL SELECT device, total, i + 1, CASE WHEN held >= 200 THEN held - 20 ELSE held END + 1 FROM h WHERE i < total), e AS (SELECT device, held FROM h WHERE i = total)
SELECT n.device, pose_id, total - k < 50 AS published FROM n JOIN e USING (device) WHERE total - k < held""")
def w12_bounded_path(spark, d):
    path = fx.poses(spark, d).withColumn("at", F.struct("ts_us", "pose_id"))
    return metrics.bounded_path(path, 200, 50, ["device"], "at").select("device", "pose_id", "published")


@query(f"""WITH RECURSIVE {fx.IMU}, n AS (SELECT device, seq, ts_us, row_number() OVER (PARTITION BY device ORDER BY ts_us, seq) AS k FROM imu),
f AS (SELECT device, k, seq, ts_us AS last_us, true AS kept FROM n WHERE k = 1 UNION ALL SELECT n.device, n.k, n.seq, CASE WHEN n.ts_us >= f.last_us + 1800000000 THEN n.ts_us ELSE f.last_us END, n.ts_us >= f.last_us + 1800000000 FROM f JOIN n ON n.device = f.device AND n.k = f.k + 1)
SELECT device, seq FROM f WHERE kept""")
def g4_throttle(spark, d):
    return metrics.throttled(fx.imu(spark, d), ["device"], "ts_us", 1 / 1800).select("device", "seq")


@query(f"""WITH RECURSIVE {fx.IMU}, n AS (SELECT device, seq, ts_us, seq % 7 AS n_points, row_number() OVER (PARTITION BY device ORDER BY ts_us, seq) AS k FROM imu),
f AS (SELECT device, k, seq, ts_us AS begin_us, n_points AS held, 0::BIGINT AS frame, n_points >= 20 AS done FROM n WHERE k = 1
UNION ALL SELECT n.device, n.k, n.seq, CASE WHEN f.done THEN n.ts_us ELSE f.begin_us END, CASE WHEN f.done THEN 0 ELSE f.held END + n.n_points, f.frame + f.done::INTEGER, (n.ts_us - CASE WHEN f.done THEN n.ts_us ELSE f.begin_us END) / 1e6 >= 3600 OR CASE WHEN f.done THEN 0 ELSE f.held END + n.n_points >= 20 FROM f JOIN n ON n.device = f.device AND n.k = f.k + 1)
SELECT device, seq, frame, begin_us FROM f""")
def g3_frame_accumulation(spark, d):
    packets = fx.imu(spark, d).select("device", "ts_us", "seq", (F.col("seq") % 7).alias("n_points"))
    return metrics.accumulated_frames(packets, ["device"], 3600, 20).select("device", "seq", "frame", "begin_us")
