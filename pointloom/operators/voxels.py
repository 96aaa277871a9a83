"""Voxel grids: keys, downsampling, policies, snapshots, deltas, statistics.

Every downsample is one hash aggregate on the voxel key with partial aggregation, so a voxel of any
number of points costs a task one row; arrival order is an explicit column, never row order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.points import usable

POLICIES = ("first", "latest", "centroid")
#: Types that a hash aggregate keeps in place.
FIXED_WIDTH = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def checked_grid(tile: float, voxel: float) -> int:
    """Voxels along a tile's edge; raises unless both sizes are positive and the tile is a whole number of voxels."""
    if not all(math.isfinite(v) and v > 0 for v in (tile, voxel)):
        raise ValueError("tile and voxel sizes have to be finite and positive")
    count = round(tile / voxel)
    if count < 1 or abs(tile / voxel - count) > 1e-9:
        raise ValueError("a tile has to be a whole number of voxels")
    return count


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("bigint")


def one_per_key(points: DataFrame, keys: list[str], keep: tuple, order: Column | str, latest: bool = False, *more: Column) -> DataFrame:
    """The first (or last) row of each key by ``order``: keys, ``keep``, and further aggregates.

    Where the order is one number or time, each column is picked on its own, so that the aggregate's buffers have
    fixed widths and Spark hashes on both sides of the shuffle. Other orders (structs) make it sort by key first.
    """
    pick = F.max_by if latest else F.min_by
    if points.select(order).dtypes[0][1] in FIXED_WIDTH:
        return points.groupBy(*keys).agg(*(pick(c, order).alias(c) for c in keep), *more)
    picked = points.groupBy(*keys).agg(pick(F.struct(*keep), order).alias("__p"), *more)
    return picked.select(*keys, "__p.*", *picked.columns[len(keys) + 1 :])


def voxel_keys(points: DataFrame, leaf: float) -> DataFrame:
    return points.select("*", *(cell(F.col(c), leaf).alias(f"g{c}") for c in "xyz"))


def tile_keys(points: DataFrame, tile: float, voxel: float) -> DataFrame:
    """Tile (tx, ty, tz) and voxel inside it (vx, vy, vz)."""
    checked_grid(tile, voxel)
    tiled = points.select("*", *(cell(F.col(c), tile).cast("int").alias(f"t{c}") for c in "xyz"))
    return tiled.select("*", *(F.floor((F.col(c) - F.col(f"t{c}") * tile) / voxel).cast("int").alias(f"v{c}") for c in "xyz"))


def first_per_voxel(points: DataFrame, leaf: float, order: Column | str, keep: tuple = ("x", "y", "z", "intensity")) -> DataFrame:
    """The first usable point of each voxel; all usable points where ``leaf`` is 0 or less."""
    good = points.where(usable(F.col("x"), F.col("y"), F.col("z")))
    if leaf <= 0:
        return good.select(*keep)
    return one_per_key(voxel_keys(good, leaf), ["gx", "gy", "gz"], keep, order)


def with_policy(points: DataFrame, policy: str, order: Column | str, keys: list[str], extra: tuple = ()) -> DataFrame:
    """One row a voxel: x, y, z, intensity, n by policy. ``centroid`` averages these four; ``extra`` columns stay the first's."""
    if policy not in POLICIES:
        raise ValueError(f"policy has to be one of {POLICIES}")
    four = ("x", "y", "z", "intensity")
    if policy == "centroid":
        chosen = [F.avg(c).alias(c) for c in four] + [F.min_by(F.struct(*extra), order).alias("p")] * bool(extra)
        grouped = points.groupBy(*keys).agg(*chosen, F.count(F.lit(1)).alias("n"))
        return grouped.select(*keys, *four, *(["p.*"] if extra else []), "n")
    return one_per_key(points, keys, (*four, *extra), order, policy == "latest", F.count(F.lit(1)).alias("n"))


def nearest_centre(points: DataFrame, leaf: float, order: Column | str, keep: tuple = ("x", "y", "z", "intensity")) -> DataFrame:
    """The point nearest to its voxel's centre. An existing point wins only if it is strictly closer, so of equal
    distances the last to arrive stays."""
    keys = ["gx", "gy", "gz"]
    keyed = voxel_keys(points, leaf)
    d2 = sum(((F.col(c) - (F.col(f"g{c}") + 0.5) * leaf) ** 2 for c in "xyz"), F.lit(0.0))
    ranked = keyed.withColumn("__d2", d2)
    least = ranked.groupBy(*keys).agg(F.min("__d2").alias("__least"))
    tied = ranked.join(least, keys).where(F.col("__d2") == F.col("__least"))
    return one_per_key(tied, keys, keep, order, latest=True)


def snapshot(voxels: DataFrame, native: float, leaf: float | None, order: Column | str) -> DataFrame:
    """The representatives, thinned again only where the wanted leaf is coarser than the native one."""
    if leaf is None or leaf <= native:
        return voxels
    return first_per_voxel(voxels, leaf, order)


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def sizes(points: DataFrame) -> DataFrame:
    """Points, those not deleted, and the deleted share. ``points(deleted)``."""
    gone = F.count_if("deleted")
    return points.agg(F.count(F.lit(1)).alias("n_points"), (F.count(F.lit(1)) - gone).alias("n_valid"), F.try_divide(gone, F.count(F.lit(1))).alias("deleted_share"))


def new_voxels(points: DataFrame, leaf: float, order: list[Column]) -> DataFrame:
    """Points that open a voxel: the delta of their frame."""
    first = Window.partitionBy("gx", "gy", "gz").orderBy(*order)
    return voxel_keys(points, leaf).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def map_statistics(points: DataFrame, leaf: float, limit: float = 1e6) -> DataFrame:
    """Observed, invalid and out-of-range points, voxels opened and refreshed, and whether anything was refused."""
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    inside = finite & usable(F.col("x"), F.col("y"), F.col("z"), most=limit)
    kind = F.when(~finite, "invalid").when(~inside, "out_of_range").otherwise("ok")
    marked = points.withColumn("kind", kind)
    keys = [F.when(F.col("kind") == "ok", F.floor(F.col(c) / leaf)).alias(f"g{c}") for c in "xyz"]
    cells = marked.select("kind", *keys).groupBy("kind", "gx", "gy", "gz").agg(F.count(F.lit(1)).alias("n"))
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("bigint")
    opened = F.count_if(F.col("kind") == "ok")
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("observed"), opened.alias("inserted"), (n("ok") - opened).alias("updated"), n("invalid").alias("rejected_invalid"),
        n("out_of_range").alias("rejected_range"), (n("invalid") + n("out_of_range") > 0).alias("incomplete"),
    )
