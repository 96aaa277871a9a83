"""Prefix scans against serial walks: hot keys, ranges and batches cut anywhere, nulls, ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import metrics, motion, scans, sync
from pointloom.sources import scratch


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def hot(rng, n):
    """(device, ts_us, seq): nine of ten rows from one device, some from none, times with ties, gaps and nulls."""
    rows, t = [], 0
    for seq in range(n):
        t += rng.choice([0, 1, 5, 50])
        device = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
        rows.append((device, None if rng.random() < 0.03 else t - rng.choice([0, 0, 0, 30]), seq))
    return rows


def in_order(rows, key):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])) if key == "ts" else sorted(rows, key=lambda r: r[2])


def serial(rows, key, test):
    out = []
    for device in {r[0] for r in rows}:
        n, before = 0, None
        for r in in_order([x for x in rows if x[0] == device], key):
            n += before is not None and r[1] is not None and test(before, r[1])
            before = r[1]
            out.append((*r, n))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_breaks_and_numbers_equal_a_serial_walk(spark, small_batches, parts):
    rows = hot(random.Random(parts), 700)
    df = spark.createDataFrame(rows, "device string, ts_us long, seq long").repartition(5)
    gaps = scans.breaks(df, ["device"], ["ts_us", "seq"], "ts_us", "n", gap=10, parts=parts)
    assert sorted((tuple(r) for r in gaps.collect()), key=str) == serial(rows, "ts", lambda a, b: b - a > 10)
    back = scans.breaks(df, ["device"], ["seq"], "ts_us", "n", parts=parts)
    assert sorted((tuple(r) for r in back.collect()), key=str) == serial(rows, "seq", lambda a, b: b < a)
    numbers = {(r["device"], r["seq"]): r["n"] for r in scans.row_numbers(df, ["device"], ["ts_us", "seq"], "n", parts=parts).collect()}
    for device in {r[0] for r in rows}:
        own = in_order([r for r in rows if r[0] == device], "ts")
        assert [numbers[device, r[2]] for r in own] == list(range(1, len(own) + 1))


def test_order_of_combination_is_kept(spark, small_batches):
    """Affine maps, which don't commute, on whole numbers."""
    rng = random.Random(3)
    rows = [(rng.random() < 0.9, i, rng.choice([1, -1]), rng.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k boolean, i long, m long, c long")
    found = scans.prefix(df, ["k"], ["i"], {"sm": F.col("m"), "sc": F.col("c")}, lambda a, b: {"sm": a["sm"] * b["sm"], "sc": a["sc"] * b["sm"] + b["sc"]}, parts=9)
    held, want = {True: (1, 0), False: (1, 0)}, {}
    for k, i, m, c in rows:
        held[k] = want[i] = held[k][0] * m, held[k][1] * m + c
    assert {r["i"]: (r["sm"], r["sc"]) for r in found.collect()} == want


def test_one_busy_key_is_many_even_ranges(spark, monkeypatch):
    tables, written = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("device"), F.lit(0).alias("ts_us"), F.col("id").alias("seq"))
    assert scans.row_numbers(df, ["device"], ["ts_us", "seq"], "n", parts=20).agg(F.max("n")).first()[0] == 18_000
    sizes = [r["count"] for r in tables[0].groupBy("__scan_part").count().collect()]
    assert len(sizes) >= 18 and max(sizes) < 3 * 20_000 / 20  # all times equal, one device 90 %: no range stands out


def test_empty_and_columns_that_stay(spark):
    none = spark.createDataFrame([], "device string, ts_us long, seq long, note string")
    assert sync.gap_frames(none, 5, ["device"]).columns == ["device", "ts_us", "seq", "note", "frame"] and sync.gap_frames(none, 5, ["device"]).count() == 0
    one = spark.createDataFrame([("a", None, 1, "x")], none.schema)
    assert [tuple(r) for r in sync.clock_epochs(one, ["device"]).collect()] == [("a", None, 1, "x", 0)]
    assert [tuple(r) for r in metrics.bounded_path(one, 5, 2, ["device"], "seq").collect()] == [("a", None, 1, "x", True)]


def poses(rows, gravity):
    """Step by step with matrices."""
    turn, v, p, out = np.eye(3), np.zeros(3), np.zeros(3), []
    for dt, a, w in rows:
        acc = turn @ a + gravity
        size = np.linalg.norm(w)
        if size > 1e-7:
            x, y, z = w / size
            k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
            turn = turn @ (np.eye(3) + np.sin(size * dt) * k + (1 - np.cos(size * dt)) * (k @ k))
        p, v = p + v * dt, v + acc * dt
        out.append([*p, *v, *turn.reshape(-1)])
    return np.array(out)


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_poses_equal_the_serial_product(spark, small_batches, parts):
    rng = np.random.default_rng(parts)
    steps = [(0.01 * rng.random(), rng.normal(0, 3, 3), rng.normal(0, 2, 3) * (rng.random() > 0.1)) for _ in range(400)]
    rows = [("hot", i, float(dt), *map(float, a), *map(float, w)) for i, (dt, a, w) in enumerate(steps)]
    rows += [("b", i, *r[2:]) for i, r in enumerate(rows[:20])]
    df = spark.createDataFrame(rows, "d string, k long, dt double, ax double, ay double, az double, gx double, gy double, gz double").repartition(4)
    found = motion.integrated(df, ["d"], "k", gravity=(0.0, 0.1, -9.81), parts=parts).orderBy("d", "k").collect()
    got = np.array([list(r)[2:] for r in found])
    want = poses(steps, np.array([0.0, 0.1, -9.81]))
    assert np.abs(got[:20] - want[:20]).max() < 1e-9 and np.abs(got[20:] - want).max() < 1e-9


def test_rest_statistics_of_one_busy_device(spark, small_batches):
    rng = np.random.default_rng(5)
    x = rng.normal([0.1, -0.2, 9.8], 0.3, (500, 3))
    df = spark.createDataFrame([("d", i, *map(float, v)) for i, v in enumerate(x)], "d string, seq long, ax double, ay double, az double").repartition(3)
    (r,) = motion.rest_statistics(df, ["d"], ["seq"], ("ax", "ay", "az")).collect()
    want = sum((x[k - 1] - x[:k].mean(axis=0)) ** 2 * (k - 1) / k for k in range(1, 501)) / 500
    assert np.allclose([r[f"mean_{a}"] for a in ("ax", "ay", "az")], x.mean(axis=0)) and r["n"] == 500 and r["done"]
    assert np.allclose([r[f"cov_{a}"] for a in ("ax", "ay", "az")], want)
