"""Golden values of point, voxel, tile and metric rules."""

import math

import pytest
from pyspark.sql import functions as F

from pointloom.functions import geometry as g
from pointloom.functions import text as tx
from pointloom.operators import metrics, points, spatial, sync, tiles, voxels


def cloud(spark, rows):
    """(x, y, z, intensity) rows in order of arrival, frame by frame."""
    out = [(f, i, *p, *([1.0] if len(p) == 3 else [])) for f, frame in enumerate(rows) for i, p in enumerate(frame)]
    return spark.createDataFrame([tuple(float(x) if k > 1 else x for k, x in enumerate(r)) for r in out], "frame_id long, idx int, x double, y double, z double, intensity double")


def test_voxel_deltas(spark):
    c = cloud(spark, [[(0.1, 0.1, 0.1), (0.2, 0.2, 0.2), (1.1, 0.1, 0.1)], [(0.3, 0.3, 0.3), (2.1, 0.1, 0.1)]])
    new = voxels.new_voxels(c, 1.0, [F.col("frame_id"), F.col("idx")]).toPandas()
    assert sorted(new.frame_id) == [0, 0, 1] and new[new.frame_id == 1].x.tolist() == [2.1]


def test_leaf_zero_passes_all(spark):
    c = cloud(spark, [[(0, 0, 0), (1, 0, 0)], [(2000, 0, 0), (2001, 0, 0)]])
    assert voxels.first_per_voxel(c, 0.1, F.struct("frame_id", "idx")).count() == 4
    assert voxels.first_per_voxel(c, 0.0, F.struct("frame_id", "idx")).count() == 4


def test_tiles_of_negative_points(spark):
    c = cloud(spark, [[(-0.001, 10, -10.001), (-10, 0, 9.999), (10, -10.001, -0.001)]])
    found = voxels.tile_keys(c, 10.0, 1.0).orderBy("idx").select("tx", "ty", "tz").collect()
    assert [tuple(r) for r in found] == [(-1, 1, -2), (-1, 0, 0), (1, -2, -1)]


def test_policies(spark):
    c = voxels.tile_keys(cloud(spark, [[(0.1, 0.1, 0.1, 2)], [(0.8, 0.2, 0.2, 8)]]), 10.0, 1.0)
    latest = voxels.with_policy(c, "latest", F.struct("frame_id", "idx"), ["tx", "ty", "tz", "vx", "vy", "vz"]).first()
    assert (latest.x, latest.intensity) == (0.8, 8.0)
    s = tiles.summary(c, "latest", ["frame_id", "idx"]).first()
    assert (s.version, s.n_voxels) == (2, 1)
    assert tiles.summary(c, "first", ["frame_id", "idx"]).first().version == 1
    c = cloud(spark, [[(0.2, 0.2, 0.2, 2), (0.6, 0.4, 0.8, 6)]])
    mid = voxels.with_policy(voxels.voxel_keys(c, 1.0), "centroid", F.col("idx"), ["gx", "gy", "gz"], extra=("idx",)).first()
    assert [round(v, 9) for v in (mid.x, mid.y, mid.z, mid.intensity)] == [0.4, 0.3, 0.5, 4.0] and mid.idx == 0
    with pytest.raises(ValueError):
        voxels.with_policy(c, "none", F.col("idx"), ["gx"])


def test_grid_check():
    assert voxels.checked_grid(10, 1) == 10
    for bad in ((10, 3), (0, 1), (10, -1), (math.nan, 1), (math.inf, 1)):
        with pytest.raises(ValueError):
            voxels.checked_grid(*bad)


def test_map_statistics(spark):
    c = cloud(spark, [[(math.nan, 0, 0), (math.inf, 0, 0), (-math.inf, 0, 0), (0.25, 0.5, 0.75, 7)]])
    s = voxels.map_statistics(c, 1.0).first()
    assert (s.observed, s.rejected_invalid, s.inserted, s.updated, s.incomplete) == (4, 3, 1, 0, True)
    empty = voxels.map_statistics(c.limit(0), 1.0).first()
    assert (empty.observed, empty.inserted, empty.incomplete) in ((0, 0, None), (0, 0, False))


def test_nearest_to_centre_ties(spark):
    c = cloud(spark, [[(0.4, 0.5, 0.5, 1), (0.6, 0.5, 0.5, 2), (0.1, 0.5, 0.5, 3)]])
    assert voxels.nearest_centre(c, 1.0, F.col("idx")).first().intensity == 2.0


def test_snapshot_only_if_coarser(spark):
    c = cloud(spark, [[(0.1, 0, 0), (1.1, 0, 0), (2.1, 0, 0)]])
    assert voxels.snapshot(c, 1.0, 0.5, F.col("idx")).count() == 3
    assert voxels.snapshot(c, 1.0, 4.0, F.col("idx")).count() == 1


def test_voxel_cap_keeps_refreshing(spark):
    c = voxels.tile_keys(cloud(spark, [[(0.1, 0, 0), (1.1, 0, 0), (2.1, 0, 0)], [(0.8, 0, 0, 9)]]), 10.0, 1.0)
    kept = tiles.voxel_cap(c, 2, ["frame_id", "idx"])
    assert sorted(kept.toPandas().x) == [0.1, 0.8, 1.1]
    full = tiles.stop_accumulating(c.withColumn("map_id", F.lit(0)), 1, ["frame_id", "idx"])
    assert sorted(full.toPandas().x) == [0.1, 0.8]


def test_bounded_batch(spark):
    changed = spark.createDataFrame([(0, 1, False, 1, 256), (0, 2, False, 1, 256), (0, 3, False, 1, 256), (0, 4, True, 0, 100)], "map_id int, seq int, deleted boolean, n_points int, n_bytes int")
    taken = lambda *most: sorted(r.seq for r in tiles.bounded_batch(changed, *most).collect())
    assert taken(1, 100, 10_000) == [4]  # deletions go first
    assert taken(2, 1, 10_000) == [1, 4]
    assert taken(10, 100, 255) == [4]
    assert taken(10, 100, 10_000) == [1, 2, 3, 4]


def test_retention_and_tombstones(spark):
    t = spark.createDataFrame([(0, 0, 0, 0, 5, 3), (0, 1, 0, 0, 9, 3), (0, 5, 0, 0, 7, 3)], "map_id int, tx int, ty int, tz int, last_frame long, n_voxels long")
    assert sorted(r.tx for r in tiles.retain_lru(t, 6).collect()) == [1, 5]
    assert sorted(r.tx for r in tiles.retain_near(t, 6, 10.0, (F.lit(0.0), F.lit(0.0), F.lit(0.0))).collect()) == [0, 1]
    gone = spark.createDataFrame([(0, 0, 0, 4), (9, 9, 9, 2)], "tx int, ty int, tz int, version long")
    had = spark.createDataFrame([(0, 0, 0, 6)], "tx int, ty int, tz int, version long")
    assert [(r.tx, r.version) for r in tiles.tombstones(gone, had).collect()] == [(0, 7)]


def test_delta_overflow(spark):
    deltas = spark.createDataFrame([(0, 1, 2), (0, 2, 2)], "map_id int, frame_id long, points long")
    rows = tiles.delta_with_overflow(deltas, 2).orderBy("frame_id").collect()
    assert [(r.dropped, r.resync) for r in rows] == [(0, False), (2, True)]


def test_shedding(spark):
    rows = spark.createDataFrame([(0, i) for i in range(3)], "q int, seq int")
    r = tiles.shedding(rows, 2, ["q"]).first()
    assert (r.kept, r.dropped) == (2, 1)


def test_timing_summary(spark):
    s = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, -1.0, math.inf])], "k int, seq int, v double")
    r = metrics.timing_summary(s, ["k"], "seq", "v", window=4).first()
    assert (r.total, r.in_window, r.average, r.p95, r.p99) == (6, 4, 4.5, 6.0, 6.0)


def test_chunks(spark):
    f = spark.createDataFrame([(0, i, 3) for i in range(5)], "recording_id int, frame_id long, n_points long")
    by_count = metrics.frame_chunks(f, 0, 2, ["recording_id"]).orderBy("frame_id").collect()
    assert [r.chunk for r in by_count] == [0, 0, 1, 1, 2]
    one = metrics.chunk_ids(f, 100, ["recording_id"], ["frame_id"]).select("chunk").distinct().collect()
    assert [r.chunk for r in one] == [0]


def test_path_bound(spark):
    p = spark.createDataFrame([(0, i) for i in range(25)], "d int, k int")
    held = []
    for n in range(1, 26):
        size = 0
        for _ in range(n):
            size = (size - 2 if size >= 20 else size) + 1
        held.append(size)
        if n in (5, 20, 21, 22, 23, 25):
            assert metrics.bounded_path(p.where(F.col("k") < n), 20, 3, ["d"], "k").count() == size


def test_log_tokens_and_fields(spark):
    t = spark.createDataFrame([("bad\n error=value",), ("",), ("x" * 400,), (None,)], "s string")
    assert [r[0] if len(r[0]) < 50 else len(r[0]) for r in t.select(tx.log_token(F.col("s"))).collect()] == ["bad__error_value", "unknown", 255, "unknown"]
    line = spark.createDataFrame([("event=processed a=1 a=2 pos=(1.5,-2,3e1) b= broken",)], "l string").select(tx.log_fields(F.col("l")).alias("m"))
    r = line.select(tx.log_value(F.col("m"), "a", "int").alias("a"), tx.log_value(F.col("m"), "event", "double").alias("e"), *(c.alias(n) for c, n in zip(tx.log_position(F.col("m")), "xyz", strict=True))).first()
    assert (r.a, r.e, r.x, r.y, r.z) == (2, None, 1.5, -2.0, 30.0)


def test_scan_rules(spark):
    """The first point is never used, and a slot that was not written holds zeros."""
    rows = [(0, 0, 9.0, 0.0, 0.0, 1.0), (0, 1, 5.0, 0.0, 0.0, 1.0), (0, 2, 5.0, 0.0, 0.0, 1.0), (0, 3, 6.0, 0.0, 0.0, 1.0), (0, 4, 1.0, 0.0, 0.0, 1.0)]
    p = spark.createDataFrame(rows, "frame_id long, idx int, x double, y double, z double, intensity double").withColumns({"line": F.lit(0), "tag": F.lit(0)})
    assert sorted(r.idx for r in points.cleaned(p, 6, 1, 4.0).collect()) == [1, 3]
    assert sorted(r.idx for r in points.cleaned(p, 6, 2, 0.0).collect()) == [2, 4]
    assert points.cleaned(p.limit(0), 6, 1, 4.0).count() == 0


def test_uint8(spark):
    v = spark.createDataFrame([(x,) for x in (-3.0, 0.5, 1.49, 254.5, 300.0, math.nan, math.inf)], "v double")
    assert [r[0] for r in v.select(g.clamp_u8(F.col("v"))).collect()] == [0, 1, 1, 255, 255, 0, 0]


def test_joins_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    p, q = rng.normal(0, 3, (400, 3)), rng.normal(0, 3, (40, 3))
    points_df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "point_id long, x double, y double, z double")
    queries = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "query_id long, qx double, qy double, qz double")
    d2 = ((q[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)
    near = {(r.query_id, r.rank, r.point_id) for r in spatial.nearest_join(queries, points_df).collect()}
    want = set()
    for i in range(len(q)):
        order = np.lexsort((np.arange(len(p)), d2[i]))[:5]
        if d2[i, order[4]] <= 5.0:
            want |= {(i, k + 1, int(j)) for k, j in enumerate(order)}
    assert near == want
    assert {(r.query_id, r.point_id) for r in spatial.radius_join(queries, points_df, 1.7).collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(d2 <= 1.7**2), strict=True)}


def test_interval_join_head_of_line(spark):
    f = spark.createDataFrame([(0, 1, 0, 10), (0, 2, 5, 100), (0, 3, 20, 30)], "device int, frame_id long, beg_us long, end_us long")
    i = spark.createDataFrame([(0, k, k * 10, 0.0) for k in range(1, 8)], "device int, seq long, ts_us long, ax double")
    assert {(r.frame_id, r.seq) for r in sync.interval_join(f, i, 16).collect()} == {(1, 1)}
    assert {(r.reason, r.frames) for r in sync.tail_report(f, i).collect()} == {("no_final_imu_coverage", 2)}
    assert sync.tail_report(f, i.limit(0)).first().reason == "no_final_imu"


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([(0, 5, "a"), (0, 10, "b"), (0, 1, "c")], "k int, t long, name string")
    right = spark.createDataFrame([(0, 5, 50), (0, 2, 20)], "k int, t long, v int")
    assert {(r.name, r.v) for r in sync.as_of(left, right, ["k"], "t", ["v"]).collect()} == {("a", 20), ("b", 50), ("c", None)}
    assert {(r.name, r.v) for r in sync.as_of(left, right, ["k"], "t", ["v"], strict=False).collect()} == {("a", 50), ("b", 50), ("c", None)}


def batch(spark, rows, *bounds):
    """Tiles (number, deleted, points, bytes) that go into the next batch, in the order in which they are offered."""
    df = spark.createDataFrame([(0, *r) for r in rows], "map_id long, seq long, deleted boolean, n_points long, n_bytes long")
    return sorted(r.seq for r in tiles.bounded_batch(df, *bounds).collect())


def test_batches_take_deletions_first(spark):
    rows = [(1, False, 5, 100), (2, True, 0, 900), (3, True, 0, 50), (4, False, 5, 100)]
    assert batch(spark, rows, 0, 0, 500) == [1, 3, 4]  # the large deletion is skipped and takes no room
    assert batch(spark, [(1, False, 5, 300), (2, True, 0, 300)], 0, 0, 400) == [2]
    assert batch(spark, rows, 2, 0, 0) == [2, 3]
    assert batch(spark, rows, 0, 0, 0) == [1, 2, 3, 4]
    assert batch(spark, [(1, False, 5, 1), (2, False, 50, 1), (3, False, 1, 1)], 0, 10, 0) == [1]  # live tiles stop at the first misfit
    assert batch(spark, [(1, True, 0, 300), (2, True, 0, 300), (3, True, 0, 100)], 0, 0, 450) == [1, 3]
    assert batch(spark, [], 1, 1, 1) == []


def test_radius_join_deals_a_query_to_the_cells_that_its_ball_meets(spark):
    """Not to all 27 around it; and places at a cell's edge, far away or not finite lose and break nothing."""
    import random

    rng = random.Random(8)
    inf, nan = float("inf"), float("nan")
    odd = [(-1e-17, 0.0, 0.0), (3.0, 0.0, 0.0), (-3.0, 0.0, 0.0), (3e15, 0.0, 0.0), (3e15 + 3, 0.0, 0.0), (1e300, 1.0, -1e300), (1e300, 2.0, -1e300), (inf, 0.0, 0.0), (-inf, 0.0, 0.0), (nan, nan, nan), (0.0, None, 0.0)]
    places = odd + [tuple(rng.choice((rng.uniform(-9, 9), float(rng.randrange(-9, 10)), rng.randrange(-30, 30) * 0.3)) for _ in "xyz") for _ in range(300)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "point_id long, x double, y double, z double")
    queries = points.selectExpr("point_id AS query_id", "x AS qx", "y AS qy", "z AS qz")

    def near(p, q):
        return None not in p and None not in q and sum((a - b) * (a - b) for a, b in zip(p, q, strict=True)) <= 9.0

    got = [(r.query_id, r.point_id) for r in spatial.radius_join(queries, points, 3.0).collect()]
    assert sorted(got) == [(i, j) for i, q in enumerate(places) for j, p in enumerate(places) if near(p, q)]
    assert (0, 1) in got and (3, 4) in got and (5, 6) in got
    inner = spark.createDataFrame([(i, *(rng.uniform(-90, 90) for _ in "xyz")) for i in range(2_000)], "query_id long, qx double, qy double, qz double")
    assert 20 < spatial.reached(inner, 3.0).count() / 2_000 < 22


def test_boxes_of_all_sizes(spark):
    import random

    rng = random.Random(5)
    pts = [(i, *(rng.uniform(-900, 900) for _ in range(3))) for i in range(400)]
    boxes = []
    for i, size in enumerate([0.5, 3, 20, 300, 5000, 1e9] * 5):
        low = [rng.uniform(-900, 900) - size / 2 for _ in range(3)]
        boxes.append((i, *(v for a in low for v in (a, a + size * rng.uniform(0.2, 1)))))
    boxes.append((99, 5.0, 5.0, 0.0, 9.0, 0.0, 9.0))  # empty
    b = spark.createDataFrame(boxes, "box_id long, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    got = {tuple(r) for r in spatial.box_join(b, spark.createDataFrame(pts, "point_id long, x double, y double, z double"), 2.0).collect()}
    assert got == {(k, i) for k, *m in boxes for i, *p in pts if all(m[2 * a] <= p[a] < m[2 * a + 1] for a in range(3))}
    assert spatial.box_join(b.limit(0), spark.createDataFrame(pts, "point_id long, x double, y double, z double"), 2.0).count() == 0


def test_as_of_against_all_rows(spark):
    """Rows before, at and far before the time asked for, in many buckets; keys without a match."""
    import random

    rng = random.Random(3)
    right = [(rng.randrange(3), rng.randrange(0, 4000), i) for i in range(120)]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())
    left = [(rng.randrange(4), rng.randrange(-50, 5000), i) for i in range(200)] + [(0, right[0][1], 900)]
    l = spark.createDataFrame(left, "k long, t long, id long")  # noqa: E741
    r = spark.createDataFrame(right, "k long, t long, v long")
    for strict in (True, False):
        want = {}
        for k, t, i in left:
            met = [x for x in right if x[0] == k and (x[1] < t or (not strict and x[1] == t))]
            want[i] = max(met, key=lambda x: x[1])[2] if met else None
        for width in (37, 1000, 10**9):
            got = {x.id: x.v for x in sync.as_of(l, r, ["k"], "t", ["v"], strict, width).collect()}
            assert got == want, (strict, width)


def test_boxes_over_a_crowd_are_not_paired_with_it(spark):
    """Points in any of many boxes: the blocks whole in a box are told without pairs, the rest and the edges point by point."""
    import numpy as np

    rng = np.random.default_rng(5)
    places = np.concatenate([rng.normal(0, 0.5, (3_000, 3)), rng.uniform(-30, 30, (600, 3)), np.repeat([[7.0, 7.0, 7.0]], 200, axis=0), [[-2.0, 0, 0], [2.0, 0, 0]]])
    rows = [(i, *map(float, p)) for i, p in enumerate(places)]
    corners = [tuple(float(c) for c in places[i] - 1) + tuple(float(c) for c in places[i] + 1.5) for i in range(0, len(places), 20)]
    corners += [(-2.0, -9.0, -9.0, 2.0, 9.0, 9.0), (7.0, 7.0, 7.0, 7.0, 8.0, 8.0), (20.0, -40.0, -40.0, 1e6, 40.0, 40.0), (5.0, 5.0, 5.0, 4.0, 9.0, 9.0)]
    boxes = spark.createDataFrame([(i, *c) for i, c in enumerate(corners)], "box_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    kept = spatial.delete_in_boxes(points, boxes, 2.0)
    hit = np.zeros(len(places), dtype=bool)
    for c in corners:
        hit |= (places >= np.array(c[:3])).all(axis=1) & (places < np.array(c[3:])).all(axis=1)
    assert sorted(r.point_id for r in kept.select("point_id").collect()) == np.flatnonzero(~hit).tolist() and 0 < hit.sum() < len(places)
    assert spatial.in_any_box(points, boxes).count() == hit.sum()


def test_pairs_of_boxes_come_cell_by_cell(spark):
    """Few boxes are not sent to all points: the points' order would decide which ids stand together in the result's files."""
    b = spark.createDataFrame([(i, *(float(i % 7), float(i % 7 + 2)) * 3) for i in range(20)], "box_id long, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    p = spark.range(300).select(F.col("id").alias("point_id"), *((F.col("id") * k % 9).cast("double").alias(c) for c, k in (("x", 1), ("y", 4), ("z", 7))))
    found = spatial.box_join(b, p, 2.0)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    inside = " AND ".join(f"{c} >= min_{c} AND {c} < max_{c}" for c in "xyz")
    assert sorted(found.collect()) == sorted(b.join(p, F.expr(inside)).select("box_id", "point_id").collect()) != []


def test_pairs_of_a_crowd_take_little_room(spark, tmp_path):
    """Boxes and points that are many in one place: files hold the pairs in less than a byte each."""
    import numpy as np

    rng = np.random.default_rng(11)
    at, low = rng.uniform(0, 2, (3_000, 3)), rng.uniform(-4, 2, (1_500, 3))
    points = spark.createDataFrame([(i * 7_919 % 3_000, *map(float, p)) for i, p in enumerate(at)], "point_id long, x double, y double, z double")
    boxes = spark.createDataFrame([(i * 20, *map(float, (*b, *(b + 5)))) for i, b in enumerate(low)], "box_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    found = spatial.box_join(boxes, points, 5.0)
    found.write.parquet(str(tmp_path / "pairs"))
    inside = ((at[None] >= low[:, None]) & (at[None] < low[:, None] + 5)).all(axis=2)
    got = spark.read.parquet(str(tmp_path / "pairs"))
    by_box = {r.box_id // 20: (r.n, r.s) for r in got.groupBy("box_id").agg(F.count("*").alias("n"), F.sum("point_id").alias("s")).collect()}
    ids = np.arange(3_000) * 7_919 % 3_000
    assert by_box == {i: (int(row.sum()), int(ids[row].sum())) for i, row in enumerate(inside) if row.any()}
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < inside.sum()


def test_crowded_cells_are_parted(spark, monkeypatch):
    """Cells of many points, some at one place, dealt in parts and shares; edges, empty boxes, places that are nowhere, ids twice or null."""
    import random

    monkeypatch.setattr(spatial, "CROWD", 16)
    rng = random.Random(4)
    inf, nan = float("inf"), float("nan")
    places = [(nan, 1.0, 1.0), (1.0, None, 1.0), (inf, 1.0, 1.0), (1.0, 1.0, -inf), (-1e-17, 0.0, 0.0), (2.0, 2.0, 2.0)] + [(1.5, 1.5, 1.5)] * 150
    places += [tuple(rng.choice((rng.uniform(-9, 9), rng.gauss(1, 0.4), float(rng.randrange(-9, 10)), rng.randrange(-30, 30) * 0.3)) for _ in "xyz") for _ in range(500)]
    points = [(None if i == 20 else 19 if i == 21 else i, *p) for i, p in enumerate(places)]
    boxes = [(i % 90, *(v for c in rng.choice(places[4:]) for v in (c - rng.choice((0.0, 1.0, 0.3)), c + rng.choice((0.0, 0.3, 2.0, 11.0, 400.0))))) for i in range(100)]
    names = ", ".join(f"{n}_{c} double" for c in "xyz" for n in ("min", "max"))
    got = spatial.box_join(spark.createDataFrame(boxes, f"box_id long, {names}"), spark.createDataFrame(points, "point_id long, x double, y double, z double"), 2.0)
    want = [(b, p) for b, *m in boxes for p, *at in points if None not in at and all(m[2 * a] <= at[a] < m[2 * a + 1] for a in range(3))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 3_000
