"""Map state of the tiled map: policies, batches cut anywhere, only touched voxels read and written."""

import random

import pytest

from pointloom.streaming import keyed

POINT = "tx int, ty int, tz int, vx int, vy int, vz int, frame_id long, idx long, x double, y double, z double, intensity double"


def run(spark, folder, pieces, policy):
    """Each piece as one batch; (rows emitted, state rows written) of each, from the same checkpoint."""
    out = []
    for k, rows in enumerate(pieces):
        spark.createDataFrame(rows, POINT).write.mode("append").parquet(f"{folder}/in")
        stream = keyed.tile_cells(spark.readStream.schema(POINT).parquet(f"{folder}/in"), policy)
        found = []
        q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, i, found=found: found.extend(df.collect())).start()
        q.awaitTermination()
        out.append((found, sum(s["numRowsUpdated"] for p in q.recentProgress for s in p["stateOperators"])))
    return out


def walk(pieces, policy):
    """Point by point."""
    cells, heads = {}, {}
    for rows in pieces:
        for r in rows:
            tile, voxel, frame, at, value = r[:3], r[:6], r[6], r[6:8], r[8:]
            head = heads.setdefault(tile, {"frames": set(), "points": 0})
            head["points"] += 1
            fresh = voxel not in cells
            if fresh or policy != "first":
                head["frames"].add(frame)
            if fresh:
                cells[voxel] = (at, 1, value)
            else:
                old_at, n, old = cells[voxel]
                if policy == "centroid":
                    cells[voxel] = (max(at, old_at), n + 1, tuple(a + b for a, b in zip(old, value, strict=True)))
                else:
                    cells[voxel] = (at, n + 1, value) if policy == "latest" else (old_at, n + 1, old)
    return cells, heads


@pytest.mark.parametrize("policy", ["first", "latest", "centroid"])
def test_policies_equal_a_walk_of_points(spark, tmp_path, policy):
    rng = random.Random(policy)
    rows = [(rng.randint(-1, 0), 0, 0, rng.randint(0, 3), rng.randint(0, 2), 0, i // 7, i % 7, rng.random(), rng.random(), rng.random(), float(i)) for i in range(150)]
    pieces = [rows[:40], rows[40:100], rows[100:]]  # frames 5 and 14 go on in the next batch
    got = run(spark, tmp_path, pieces, policy)
    cells, heads = walk(pieces, policy)
    now = {}
    for found, _ in got:
        now |= {(r.tx, r.ty, r.tz, r.vx, r.vy, r.vz): r for r in found}
    assert set(now) == set(cells)
    for voxel, (at, n, value) in cells.items():
        r = now[voxel]
        want = [v / n for v in value] if policy == "centroid" else value
        assert r.n == n and [r.x, r.y, r.z, r.intensity] == pytest.approx(want)
        assert policy == "centroid" or (r.frame_id, r.idx) == at
    for tile, head in heads.items():
        last = max((r for v, r in now.items() if v[:3] == tile), key=lambda r: r.version)
        assert (last.version, max(r.n_points for v, r in now.items() if v[:3] == tile)) == (len(head["frames"]), head["points"]) or policy == "first"
        assert max(r.n_voxels for v, r in now.items() if v[:3] == tile) == sum(v[:3] == tile for v in cells)


def test_only_touched_voxels_are_written(spark, tmp_path):
    many = [(0, 0, 0, i % 40, i // 40, 0, 1, i, 0.5, 0.5, 0.5, 1.0) for i in range(800)]
    few = [(0, 0, 0, 3, 3, 0, 2, 0, 0.1, 0.2, 0.3, 9.0), (0, 0, 0, 99, 0, 0, 2, 1, 0.1, 0.2, 0.3, 9.0)]
    (first, wrote_first), (second, wrote_second) = run(spark, tmp_path, [many, few], "latest")
    assert len(first) == 800 and len(second) == 2 and {r.n_voxels for r in second} == {801}
    assert wrote_first >= 800 and wrote_second <= 6  # two cells, their counters, and the head


def test_given_centroid_and_unknown_policy(spark, tmp_path):
    rows = [(0, 0, 0, 0, 0, 0, 1, 0, 0.2, 0.2, 0.2, 2.0), (0, 0, 0, 0, 0, 0, 1, 1, 0.6, 0.4, 0.8, 6.0)]
    ((found, _),) = run(spark, tmp_path, [rows], "centroid")
    assert [found[0].x, found[0].y, found[0].z, found[0].intensity] == pytest.approx([0.4, 0.3, 0.5, 4.0]) and found[0].version == 1
    with pytest.raises(ValueError):
        keyed.tile_cells(spark.createDataFrame([], POINT), "average")


def test_queue_in_any_cut_equals_the_batch_walk(spark, tmp_path):
    from pointloom.operators import tiles

    rng = random.Random(9)
    rows = [(m, f, rng.randint(1, 30)) for f in range(60) for m in (0, 1)]
    want = sorted(tuple(r) for r in tiles.delta_with_overflow(spark.createDataFrame(rows, "map_id long, frame_id long, points long"), 40).collect())
    assert any(r[4] for r in want)
    for cut in ([len(rows)], [1, 2, 50, len(rows)]):
        at, found, folder = 0, [], f"{tmp_path}/{len(cut)}"
        for end in cut:
            spark.createDataFrame(rows[at:end], "map_id long, frame_id long, points long").write.mode("append").parquet(f"{folder}/in")
            stream = keyed.delta_queue(spark.readStream.schema("map_id long, frame_id long, points long").parquet(f"{folder}/in"), 40)
            q = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, i, found=found: found.extend(df.collect())).start()
            q.awaitTermination()
            at = end
        assert sorted(tuple(r) for r in found) == want


def test_given_overflow_sequence(spark, tmp_path):
    rows = [(0, 1, 2), (0, 2, 2)]
    spark.createDataFrame(rows, "map_id long, frame_id long, points long").write.parquet(f"{tmp_path}/in")
    found = []
    q = keyed.delta_queue(spark.readStream.schema("map_id long, frame_id long, points long").parquet(f"{tmp_path}/in"), 2).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    q.foreachBatch(lambda df, i: found.extend(df.collect())).start().awaitTermination()
    assert sorted(tuple(r) for r in found) == [(0, 1, 2, 0, False), (0, 2, 2, 2, True)]


def test_late_rows_and_rejected_rows_are_counted_in_the_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from pointloom.streaming import feeds

    late, total, state = 0, {}, f"{tmp_path}/state"
    watermark = None
    for k, times in enumerate([[0, 60, 7200], [7300, 100, 200, 9000], [9100, 8000, 20_000]]):
        if watermark is not None:
            late += len({t // 3600 for t in times if t // 3600 * 3600 + 3600 <= watermark})  # a task's rows of a window are dropped as one
        watermark = max([*times, watermark or 0])
        rows = spark.createDataFrame([(1, t, float(t)) for t in times], "device long, t long, ax double")
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").select("device", "ax", F.timestamp_seconds("t").alias("ts"))
        seen = stream.observe("seen", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ax") >= 9000).alias("high"))
        found = feeds.run_observed(feeds.windowed_counts(seen, "1 hour", "0 seconds"), feeds.batch_sink(f"{tmp_path}/out"), state, "seen")
        total = {n: total.get(n, 0) + v for n, v in found.items()}
    assert total["rows"] == 10 and total["high"] == 3 and total["late"] == late == 1
