"""Exact top-k inner product by ball trees with branch and bound.

Candidates are put into shards of a bounded number of vectors, the longest vectors first. A shard's ball tree is built
once (numpy) and stored with it as one row. Rounds take the shards in order, one, then twice as many as before: a query
goes to a shard only if the bound of the shard's own ball (``q.c + |q| r``, or ``|q|`` times the longest vector) reaches
the query's current k-th score, which all shards share: each round starts from the k best of all rounds before it. In a
shard a query orders the leaves by the same bound and goes down that order until the bound falls below its k-th
score; nodes whose bound is too low close their whole subtree. Bounds are strict, so ties survive and the result is exact.

Queries are dealt in blocks of a bounded number and size, each packed once. What goes between a round's two steps is, for a
shard and a block, which of the block's queries go there (four bytes each); a task holds one shard and one block, never
pairs of vectors.

Defined results
    * vectors null or holding null or non-finite components take no part, nor rows without id; an empty vector
      takes part, with score 0 to all;
    * a shorter vector counts as filled up with zeros;
    * scores are exact integers; beyond the range of a long they are held at its ends;
    * rows that repeat an id are each candidates (but not for a query of that id); as a query an id
      counts once, by its smallest vector;
    * ties go to the smaller vec_id; fewer candidates than k: all of them; an empty table: no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm import common

SHARD, BLOCK, LEAF = 16_384, 4_096, 256
#: Bytes of the vectors of a shard, a block, or the centers of a group of shards (longer vectors: fewer of them).
MOST_BYTES = 64 << 20
_LOW = -(1 << 63)


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``(vec_id, embedding)`` to (vec_id, v binary): floor(scale * x) as little-endian doubles (they hold
    the integers exactly). Rows that take no part go here."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if vec_id is None or values is None or any(x is None for x in values):
                    continue
                v = np.array(values, dtype=np.float64)
                if np.isfinite(v).all():
                    ids.append(vec_id)
                    out.append(np.floor(scale * v).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(scan, "vec_id long, v binary")


class Tree:
    """Balls in an array: node i has the children 2i+1 and 2i+2; leaves hold runs of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.center, self.radius, self.children, self.runs = [], [], [], []
        self._split(points, 0, len(points), leaf)
        self.center, self.radius = np.array(self.center), np.array(self.radius)
        self.leaves = [i for i, c in enumerate(self.children) if c is None]

    def _split(self, points: np.ndarray, low: int, high: int, leaf: int) -> int:
        own = points[self.order[low:high]]
        center = own.mean(axis=0)
        away = ((own - center) ** 2).sum(axis=1)
        node = len(self.center)
        self.center.append(center)
        self.radius.append(float(np.sqrt(away.max())))
        self.children.append(None)
        self.runs.append((low, high))
        if high - low > leaf:
            a = own[away.argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            along = np.argsort(own @ (b - a), kind="stable")  # equal points are halved as well
            self.order[low:high] = self.order[low:high][along]
            middle = (low + high) // 2
            self.children[node] = (self._split(points, low, middle, leaf), self._split(points, middle, high, leaf))
        return node


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers: doubles where they hold every sum, else Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], dtype=object) @ np.array([[int(x) for x in r] for r in b], dtype=object).T
    return np.clip(exact, _LOW, -_LOW - 1).astype(np.int64)


def bounds(queries: np.ndarray, center: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Above every inner product of a query with a point of a ball, queries by balls."""
    norm = np.sqrt((queries**2).sum(axis=1))
    bound = queries @ center.T + norm[:, None] * radius[None, :]
    return bound + 1e-9 * (np.abs(bound) + norm[:, None] * np.sqrt((center**2).sum(axis=1))[None, :]) + 1e-6  # what rounding may take


def search(tree: Tree, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vec_id, score) of the k best of each query in this shard with a score of ``floor`` or more."""
    bound = bounds(queries, tree.center, tree.radius)
    for node, below in enumerate(tree.children):  # parents come first: a child's bound is no higher
        for child in below or ():
            np.minimum(bound[:, child], bound[:, node], out=bound[:, child])
    leaves = np.array(tree.leaves)
    bound = bound[:, leaves]
    order = np.argsort(-bound, axis=1, kind="stable")
    kth = floor.copy()
    got = [np.empty(0, np.int64)] * 3  # query's place, score, vec_id: at most k a query
    going = np.arange(len(queries))
    for turn in range(len(leaves)):
        going = going[bound[going, order[going, turn]] >= kth[going]]
        if not len(going):
            break
        at = order[going, turn]
        fresh = []
        for leaf in np.unique(at).tolist():
            asked = going[at == leaf]
            low, high = tree.runs[leaves[leaf]]
            spots = tree.order[low:high]
            score = inner(queries[asked], points[spots])
            row, column = np.nonzero((score >= kth[asked][:, None]) & (ids[spots][None, :] != query_ids[asked][:, None]))
            fresh.append((asked[row], score[row, column], ids[spots[column]]))
        new = [np.concatenate(c) for c in zip(*fresh, strict=True)]
        if len(new[0]):
            place, score, vec_id = (np.concatenate(c) for c in zip(got, new, strict=True))
            sort = np.lexsort((vec_id, -score.astype(object) if (score == _LOW).any() else -score, place))
            place, score, vec_id = place[sort], score[sort], vec_id[sort]
            rank = np.arange(len(place)) - np.searchsorted(place, place)
            kept = rank < k
            last = rank == k - 1
            kth[place[last]] = np.maximum(kth[place[last]], score[last])
            got = [place[kept], score[kept], vec_id[kept]]
    return got[0], got[2], got[1]


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        v = np.frombuffer(r, "<f8")[:width]
        out[i, : len(v)] = v
    return out


SHARDS = "shard long, longest double, radius double, center binary, tree binary"


def sharded(points: DataFrame, n: int, size: int) -> DataFrame:
    """``points(vec_id, v)`` as shards of at most ``size`` vectors, numbered from the longest vectors down, a row each."""

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(np.sqrt((np.frombuffer(v, "<f8") ** 2).sum())) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(found, pa.float64())], names=["vec_id", "v", "norm"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, rows, longest = TaskContext.get().partitionId(), 0, [], [], 0.0

        def close() -> pa.RecordBatch:
            values = _matrix(rows, max(1, max(len(r) // 8 for r in rows)))
            tree = Tree(values)
            whole = pickle.dumps((tree, values, np.array(ids, dtype=np.int64)), protocol=5)
            columns = [[part << 20 | number], [longest], [float(tree.radius[0])], [tree.center[0].astype("<f8").tobytes()], [whole]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in SHARDS.split(", ")])

        for batch in batches:
            for vec_id, v, norm in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), batch.column("norm").to_pylist(), strict=True):
                ids.append(vec_id)
                rows.append(v)
                longest = max(longest, norm)
                if len(ids) == size:
                    yield close()
                    number, ids, rows, longest = number + 1, [], [], 0.0
        if ids:
            yield close()

    # equal lengths, and one vector many times, are told apart by a hash of the id
    placed = points.mapInArrow(norms, "vec_id long, v binary, norm double").repartitionByRange(-(-n // size), F.desc("norm"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("norm"))
    return common.written(placed.mapInArrow(build, SHARDS), "top-k-shards")


def top_k(candidates: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK, group: int = 1_024, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``candidates(vec_id, v)``, ``queries(vec_id, v)`` to (query_id, rank, vec_id, score).

    Work is that of all queries against the shards that may still hold one of their k best, in blocks.
    """
    spark = candidates.sparkSession
    points = common.written(candidates, "top-k-points")
    asked = common.written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "top-k-queries")
    n, m = points.count(), asked.count()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wide = max(8, *(df.agg(F.max(F.octet_length("v"))).first()[0] for df in (points, asked)))
    fit = max(1, most_bytes // wide)
    shard, block, group = min(shard, fit), min(block, fit), min(group, fit)
    shards = sharded(points, n, shard)
    order = [r["shard"] for r in shards.select("shard").orderBy("shard").collect()]  # a number for each ``shard`` vectors
    blocks, groups = -(-m // block), -(-len(order) // group)
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    balls = shards.select("shard", "longest", "radius", "center").withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        values = rows.column("v").to_pylist()
        width = max(1, *(len(x) // 8 for x in values))
        return pa.table([rows.column("block").slice(0, 1), pa.array([rows.column("vec_id").to_numpy().tobytes()]), pa.array([width], pa.int32()), pa.array([_matrix(values, width).tobytes()], pa.binary())], names=["block", "ids", "width", "vectors"])

    packed = common.written(dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, width int, vectors binary"), "top-k-blocks")

    def unpacked(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, vectors and floors of a block's queries."""
        ids, width = np.frombuffer(right.column("ids")[0].as_py(), np.int64), right.column("width")[0].as_py()
        return ids, np.frombuffer(right.column("vectors")[0].as_py(), np.float64).reshape(len(ids), width), right.column("floors").combine_chunks().flatten().to_numpy()

    def reach(left: pa.Table, right: pa.Table) -> pa.Table:
        """Which queries of a block (right) go to which shards of a group (left): places in the block."""
        shard_of, places = [], []
        if left.num_rows and right.num_rows:
            _, q, floor = unpacked(right)
            centers = left.column("center").to_pylist()
            width = max(q.shape[1], *(len(x) // 8 for x in centers))
            q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
            bound = np.minimum(bounds(q, _matrix(centers, width), left.column("radius").to_numpy()), bounds(q, np.zeros((left.num_rows, width)), left.column("longest").to_numpy()))
            for column, number in zip((bound >= floor[:, None]).T, left.column("shard").to_pylist(), strict=True):
                if column.any():
                    shard_of.append(number)
                    places.append(np.flatnonzero(column).astype(np.int32).tobytes())
        own = right.column("block")[0].as_py() if right.num_rows else 0
        return pa.table([pa.array(shard_of, pa.int64()), pa.array([own] * len(shard_of), pa.int32()), pa.array(places, pa.binary())], names=["shard", "block", "places"])

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best of the queries of a block (right) that go to a shard (left)."""
        place = vec_id = score = np.empty(0, dtype=np.int64)
        query_ids = np.empty(0, dtype=np.int64)
        if left.num_rows and right.num_rows:
            tree, values, ids = pickle.loads(left.column("tree")[0].as_py())
            query_ids, q, floor = unpacked(right)
            at = np.frombuffer(left.column("places")[0].as_py(), np.int32)
            query_ids, q, floor = query_ids[at], q[at], floor[at]
            q = np.pad(q, ((0, 0), (0, max(0, values.shape[1] - q.shape[1]))))[:, : values.shape[1]]  # what lies beyond the shard's width meets zeros
            place, vec_id, score = search(tree, values, ids, q, query_ids, floor, k)
        return pa.table({"query_id": query_ids[place], "vec_id": vec_id, "score": score})

    found, at, width = spark.createDataFrame([], "query_id long, vec_id long, score long"), 0, 1
    while at < len(order):
        low, high = order[at], order[min(at + width, len(order)) - 1]
        now = F.col("shard").between(low, high)
        kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        floors = dealt.join(kth, dealt.vec_id == kth.query_id, "left").select("vec_id", "block", F.coalesce("least", F.lit(_LOW).cast("long")).alias("floor"))
        listed = floors.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "floor"))), lambda x: x["floor"]).alias("floors"))
        listed = common.written(listed, "top-k-floors")  # a number a query; both steps of the round read it
        ready = packed.join(listed, "block")
        spread = ready.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        around = balls.where(now).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        going = common.written(around.groupBy("group", "block").cogroup(spread.groupBy("group", "block")).applyInArrow(reach, "shard long, block int, places binary"), "top-k-going")
        trees = shards.where(now).select("shard", "tree").join(going, "shard").select(F.col("shard").alias("of"), F.col("block").alias("by"), "tree", "places")
        asking = going.select("shard", "block").join(ready, "block")
        fresh = trees.groupBy("of", "by").cogroup(asking.groupBy("shard", "block")).applyInArrow(one, "query_id long, vec_id long, score long")
        merged = found.unionByName(fresh).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
        found = common.written(merged, "top-k-found")
        at, width = at + width, 2 * width
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = quantised(common.read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(points, points.where("vec_id % 20 = 0"), k=20)


OP9_SQL = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
