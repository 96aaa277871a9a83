"""Labels of scan lines with known shapes."""

import numpy as np

from pointloom.operators import motion, scan


def line(spark, xyz):
    return spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "frame_id long, idx int, x double, y double, z double")


def labels(spark, xyz):
    m = scan.geometry(line(spark, xyz), ["frame_id"], "idx")
    return [r.label for r in scan.scan_labels(m, ["frame_id"], "idx").orderBy("idx").collect()]


def test_wall_is_a_plane(spark):
    found = labels(spark, [(5, 0.1 * i, 0) for i in range(40)])
    assert found[1:25].count(scan.PLANE) + found[1:25].count(scan.MAYBE_PLANE) == 24


def test_noise_is_no_plane(spark):
    rng = np.random.default_rng(0)
    found = labels(spark, rng.normal(0, 1, (40, 3)) + [5, 0, 0])
    assert found.count(scan.PLANE) < 12


def test_short_lines(spark):
    for n in (1, 2, 3, 7):
        assert len(labels(spark, [(5, 0.1 * i, 0) for i in range(n)])) == n


def test_integration(spark):
    """Constant acceleration without turning gives the sums of uniform motion."""
    steps = spark.createDataFrame([(0, i, 0.1, 1.0, 0.0, 9.81, 0.0, 0.0, 0.0) for i in range(5)], "d int, k int, dt double, ax double, ay double, az double, gx double, gy double, gz double")
    rows = motion.integrated(steps, ["d"], "k").orderBy("k").collect()
    assert [round(r.vx, 9) for r in rows] == [0.1, 0.2, 0.3, 0.4, 0.5]
    assert [round(r.px, 9) for r in rows] == [0.0, 0.01, 0.03, 0.06, 0.1]
    turned = steps.withColumn("gz", steps.dt * 0 + np.pi / 2 / 0.1)
    last = motion.integrated(turned, ["d"], "k").orderBy("k").first()
    assert round(last.r0, 9) == 0 and round(last.r3, 9) == 1
