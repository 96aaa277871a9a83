"""Centroid clustering (Lloyd's rounds) with Orchard's search for the nearest centroid.

For each centroid there is a list of the others by distance. A vector starts at some centroid and walks its list;
whenever a listed centroid is closer, it jumps to that one's list. Centroids already measured are marked and not
measured again. The walk ends where the list goes strictly beyond twice the current distance: what follows cannot be
closer, nor as close, by the triangle inequality, so ties are all met. All arithmetic is on whole numbers, squared
distances included: the bound is tested as ``D(c, s) > 4 * d``.

A round is one pass over the vectors: tasks assign their rows and add them up, one sum a centroid and component leaves
a task, Spark adds those. The driver holds the centroids only (their number times their length).

Defined results
    * vectors that are null, have another length, or hold null or non-finite components take no part;
    * components are floor(scale * x), exact at any size; squared distances beyond a long are held at its end;
    * the first centroids are the vectors with the smallest hash of their id, ties by components; an id that is null
      counts as the empty text there, and its row takes part; repeated rows each take part;
    * equal distances go to the smaller centroid number; a centroid without vectors stays;
    * fewer vectors than centroids: as many centroids as vectors; an empty table: no rows;
    * vectors of length zero all have distance 0 and go to centroid 0; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common

CENTROIDS, ROUNDS, LENGTH, SCALE = 8, 10, 64, 1_024
#: Rows that are assigned at once.
BLOCK = 8_192
#: Components up to WHOLE have squared distances within a long (of up to 2**13 components); larger ones are Python's
#: integers. Sums leave a task in digits of LIMB bits.
WHOLE, LIMB = 1 << 24, 40
_LONG = (1 << 63) - 1


def whole_vectors(lists: pa.Array, length: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their components floor(scale * x): longs, or Python's integers where a long is too short."""
    lists = pa.concat_arrays([lists])
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(size == length)
    flat = pc.list_flatten(lists.take(pa.array(fits)))
    x = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(fits), length)
    sound = np.isfinite(x).all(axis=1)
    x, fits = x[sound], fits[sound]
    if np.abs(x).max(initial=0) * scale <= WHOLE:
        return fits, np.floor(x * scale).astype(np.int64)
    exact = [[int(v) * scale if abs(v) >= 1 << 53 else (lambda n, d: n * scale // d)(*v.as_integer_ratio()) for v in row] for row in x.tolist()]
    return fits, np.array(exact, dtype=object).reshape(len(fits), length)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``a`` and ``b``, exact."""
    away = a - b
    return (away * away).sum(axis=-1)


class Lists:
    """Centroids with their neighbour lists: ``near[c]`` has all others by distance from c (ties by number)."""

    def __init__(self, centroids: list[list[int]]):
        k = len(centroids)
        small = max((abs(x) for c in centroids for x in c), default=0) <= WHOLE
        self.at = np.array(centroids, dtype=np.int64 if small else object).reshape(k, -1)
        self.between = squared(self.at[:, None, :], self.at[None, :, :])
        if not self.at.shape[1]:
            self.between = np.zeros((k, k), dtype=np.int64)
        self.near = np.array([sorted((s for s in range(k) if s != c), key=lambda s: (self.between[c][s], s)) for c in range(k)], dtype=np.int64).reshape(k, k - 1)
        self.measured = 0  # distances taken, start included

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row (ties: smaller number), and the squared distance. Rows walk side by side."""
        n, k = len(points), len(self.at)
        if not points.shape[1]:
            return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        own = np.zeros(n, dtype=np.int64)
        best = squared(points, self.at[0])
        seen = np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        self.measured += n
        going, place = np.arange(n), np.zeros(n, dtype=np.int64)
        while len(going):
            going = going[place[going] < k - 1]
            s = self.near[own[going], place[going]]
            reach = (self.between[own[going], s] <= 4 * best[going]).astype(bool)  # strictly beyond twice the distance: done
            going, s = going[reach], s[reach]
            place[going] += 1
            new = ~seen[going, s]
            rows, s = going[new], s[new]
            seen[rows, s] = True
            self.measured += len(rows)
            d = squared(points[rows], self.at[s])
            closer = ((d < best[rows]) | ((d == best[rows]) & (s < own[rows]))).astype(bool)
            rows = rows[closer]
            own[rows], best[rows], place[rows] = s[closer], d[closer], 0  # on in that one's list, from its start
        return own, best


def _blocks(batches: Iterator[pa.RecordBatch], length: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            part = batch.slice(first, BLOCK)
            rows, points = whole_vectors(part.column("embedding"), length, scale)
            yield part.column("vec_id").take(pa.array(rows)), points


def _digits(total: int) -> list[int]:
    out = []
    while total not in (0, -1):
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]  # the last one has the sign


def lloyd(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """``vectors(vec_id, embedding)`` to (vec_id, cluster int, distance long) by the centroids after ``rounds`` rounds, and
    these centroids."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = (F.size("embedding") == length) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = plain.where(F.coalesce(sound, F.lit(False))).orderBy(order, "embedding").limit(k).collect()
    kind = pa.list_(pa.float64())
    centroids = [[int(x) for x in v] for v in whole_vectors(pa.array([r["embedding"] for r in first], kind), length, scale)[1]]
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    for _ in range(rounds):
        centroids = moved(plain, centroids, scale)
    lists = Lists(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in _blocks(batches, length, scale):
            own, best = lists.nearest(points)
            if best.dtype == object:
                best = np.array([min(int(x), _LONG) for x in best], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return plain.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def moved(plain: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Centroids after one round: the exact floor of the mean of the vectors nearest to each; those without any stay."""
    lists, length = Lists(centroids), len(centroids[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * length for _ in centroids], [0] * len(centroids)
        for _, points in _blocks(batches, length, scale):
            own, _ = lists.nearest(points)
            for c in np.unique(own).tolist():
                rows = points[own == c]
                counts[c] += len(rows)
                sums[c] = [a + int(b) for a, b in zip(sums[c], rows.sum(axis=0), strict=True)]
        found = [(c, -1, 0, n) for c, n in enumerate(counts) if n]
        found += [(c, i, j, digit) for c, n in enumerate(counts) if n for i, total in enumerate(sums[c]) for j, digit in enumerate(_digits(total)) if digit]
        columns = zip(*found, strict=True) if found else [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "component", "digit", "total"])

    parts = plain.mapInArrow(add, "cluster int, component int, digit int, total long")
    summed = parts.groupBy("cluster", "component", "digit").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()  # centroids times components (a few digits each)
    counts, sums = [0] * len(centroids), [[0] * length for _ in centroids]
    for r in summed:
        if r["component"] < 0:
            counts[r["cluster"]] = int(r["total"])
        else:
            sums[r["cluster"]][r["component"]] += int(r["total"]) << (LIMB * r["digit"])
    return [[s // n for s in total] if n else old for old, total, n in zip(centroids, sums, counts, strict=True)]


def summed_up(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned(vec_id, cluster, distance)`` with cluster_inertia, inertia long (at most a long's end) and centroid_sha256."""
    if not centroids:
        empty = F.lit(None).cast("long")
        return assigned.select("*", empty.alias("cluster_inertia"), empty.alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    held = common.written(assigned, "clusters")
    each = {r["cluster"]: int(r["total"]) for r in held.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("total")).collect()}
    whole = min(sum(each.values(), 0), _LONG)
    rows = [(c, min(each.get(c, 0), _LONG), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    table = held.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return held.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")  # a row a centroid


def op11_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed_up(*lloyd(common.read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def _op11_sql() -> str:
    """Rounds written out: distances from sums over (vector, component) rows, new centroids by exact floor."""
    near = (
        "SELECT vec_id, (arg_min(cluster, (d, cluster)))::INTEGER AS cluster, min(d) AS distance FROM "
        "(SELECT p.vec_id, c.cluster, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d FROM points p JOIN c{0} c USING (i) GROUP BY 1, 2) GROUP BY 1"
    )
    steps = []
    for i in range(ROUNDS):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(i)})",
            f"s{i} AS MATERIALIZED (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM points JOIN a{i} USING (vec_id) GROUP BY 1, 2)",
            f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} c LEFT JOIN s{i} s ON s.cluster = c.cluster AND s.i = c.i)",
        ]
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept),
chosen AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS cluster FROM kept),
c0 AS MATERIALIZED (SELECT cluster, i, x FROM points JOIN chosen USING (vec_id) WHERE cluster < {CENTROIDS}),
{", ".join(steps)},
last AS MATERIALIZED ({near.format(ROUNDS)}),
names AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM last JOIN names USING (cluster)
"""


OP11_SQL = _op11_sql()
