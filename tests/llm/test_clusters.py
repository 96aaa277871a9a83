import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def plain(rows, k, rounds, length, scale=1024, seed=3):
    """One vector and one centroid at a time, with Python's integers."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e15 else scale * int(x) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            own = [v for (_, v), m in zip(kept, mine, strict=True) if m == j]
            if own:
                at[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *nearest(v)) for i, v in kept]
    each = {j: sum(d for _, d, m in out if m == j) for j in range(len(at))}
    end = (1 << 63) - 1
    return sorted(((i, j, min(d, end), min(each[j], end), min(sum(min(d, end) for _, d, _ in out), end), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, d, j in out), key=str)


def taken(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_nearest_is_that_of_all_centroids_with_fewer_distances():
    rng = np.random.default_rng(1)
    for k in (1, 2, 7, 40):
        at = rng.integers(-50, 50, (k, 3))
        at[k // 2] = at[0]  # a tie of centroids
        points = np.concatenate([rng.integers(-60, 60, (500, 3)), at])
        lists = clusters.Lists(at.tolist())
        own, best = lists.nearest(points)
        all_of = ((points[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
        assert (best == all_of.min(axis=1)).all() and (own == all_of.argmin(axis=1)).all()
        assert lists.measured < len(points) * k or k < 3


def test_lists_are_in_order_and_walks_stop(monkeypatch):
    lists = clusters.Lists([[0], [10], [100], [1000]])
    assert lists.near.tolist() == [[1, 2, 3], [0, 2, 3], [1, 0, 3], [2, 1, 0]]
    lists.nearest(np.array([[0], [1]]))
    assert lists.measured == 2  # 10 is beyond twice the distance of both
    lists = clusters.Lists([[0], [10], [100], [1000]])
    own, best = lists.nearest(np.array([[5], [990]]))
    assert own.tolist() == [0, 3] and best.tolist() == [25, 100] and lists.measured == 2 + 1 + 3


def test_clusters_equal_plain_rounds(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.25, -1.5, rng.uniform(-2, 2)]) for _ in range(3)]) for i in range(200)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, [1.0, 1.0, 1.0]), (300, None), (301, [1.0, None, 2.0]), (302, [float("nan"), 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0]), (304, []), (305, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA).repartition(3)
    for k, rounds in ((8, 10), (1, 2), (5, 0), (400, 3)):
        assert taken(clusters.summed_up(*clusters.lloyd(df, k=k, rounds=rounds, length=3))) == plain(rows, k, rounds, 3)


def test_huge_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 9, 18, 30]) for _ in range(2)]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA).repartition(2)
    assert taken(clusters.summed_up(*clusters.lloyd(df, k=4, rounds=3, length=2))) == plain(rows, 4, 3, 2)


@pytest.mark.parametrize("total", [0, 1, -1, 5, -5, 1 << 40, -(1 << 40), (1 << 200) + 12345, -(1 << 200) + 7])
def test_sums_in_digits(total):
    assert sum(d << (clusters.LIMB * j) for j, d in enumerate(clusters._digits(total))) == total


def test_empty_and_equal(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    assert clusters.summed_up(*clusters.lloyd(none)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clusters.op11_orchard_clusters(spark, folder(embeddings=none)).count() == 0
    same = spark.createDataFrame([(i, [0.5] * 64, 1, "x") for i in range(20)], SCHEMA)
    rows = clusters.op11_orchard_clusters(spark, folder(embeddings=same)).collect()
    assert len(rows) == 20 and {(r["cluster"], r["distance"], r["inertia"]) for r in rows} == {(0, 0, 0)}
    long = spark.createDataFrame([(i, [], 1, "x") for i in range(3)], SCHEMA)
    assert [r[1:3] for r in clusters.lloyd(long, length=0)[0].collect()] == [(0, 0)] * 3


def test_rows_that_take_part():
    lists = pa.array([[1.0, 2.0], None, [1.0], [None, 1.0], [float("nan"), 1.0], [-0.001, 1e30]], pa.list_(pa.float64()))
    rows, points = clusters.whole_vectors(lists.slice(0, 5), 2, 1024)
    assert rows.tolist() == [0] and points.tolist() == [[1024, 2048]]
    rows, points = clusters.whole_vectors(lists, 2, 1024)
    assert rows.tolist() == [0, 5] and points.tolist() == [[1024, 2048], [-2, 1024 * int(1e30)]]


def test_whole_table_equals_plain(spark, small):
    got = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()
    assert taken(clusters.op11_orchard_clusters(spark, small)) == plain([tuple(r) for r in got], 8, 10, 64)
