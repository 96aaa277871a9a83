"""The tiled voxel map: versions, summaries, bounded change batches, budgets and retention.

A map is one recording's (``map_id``): all orders and running sums are by map, so many maps go side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators import scans
from pointloom.operators.walks import walked

TILE = ["tx", "ty", "tz"]
VOXEL = ["vx", "vy", "vz"]


def changes(points: DataFrame, policy: str, order: list[str]) -> DataFrame:
    """Distinct (tile, frame) in which the frame changed the tile: with a new voxel for ``first``, else with any point."""
    if policy == "first":
        opened = Window.partitionBy(*TILE, *VOXEL).orderBy(*order)
        points = points.withColumn("__n", F.row_number().over(opened)).where("__n = 1")
    return points.select(*TILE, "frame_id").distinct()


def versions(changed: DataFrame) -> DataFrame:
    """Changes with the tile's version after the frame: 1, 2, ..."""
    return changed.withColumn("version", F.dense_rank().over(Window.partitionBy(*TILE).orderBy("frame_id")).cast("bigint"))


def summary(points: DataFrame, policy: str, order: list[str]) -> DataFrame:
    """Tile, version, voxels, points, last frame that changed it."""
    counts = points.groupBy(*TILE, *VOXEL).agg(F.count(F.lit(1)).alias("n")).groupBy(*TILE).agg(F.count(F.lit(1)).alias("n_voxels"), F.sum("n").alias("n_points"))
    touched = changes(points, policy, order).groupBy(*TILE).agg(F.count(F.lit(1)).alias("version"), F.max("frame_id").alias("last_frame"))
    return counts.join(touched, TILE)


def dirty(points: DataFrame, delivered: DataFrame) -> DataFrame:
    """Rows of tiles whose version is higher than the delivered one (or never delivered)."""
    now = versions(changes(points, "latest", [])).groupBy(*TILE).agg(F.max("version").alias("version"))
    old = delivered.select(*TILE, F.col("version").alias("__delivered"))
    stale = now.join(old, TILE, "left").where(F.col("__delivered").isNull() | (F.col("version") > F.col("__delivered"))).select(*TILE)
    return points.join(stale, TILE, "left_semi")


def bounded_batch(changed: DataFrame, max_tiles: int, max_points: int, max_bytes: int) -> DataFrame:
    """Rows of ``changed(map_id, seq, deleted, n_points, n_bytes)`` that go into each map's next batch; a bound of 0 is none.

    Deletions (no points) go first, in order of seq; one that doesn't fit is skipped and takes no room. Live tiles follow
    in order of seq and stop at the first that doesn't fit beside what was taken.
    """
    live = ~F.col("deleted")
    some = changed
    if max_bytes:  # alone too large: a deletion is skipped anyway; a live tile stays, for it ends the batch
        some = some.where(live | (F.col("n_bytes") <= max_bytes))
    if max_tiles:  # live tiles are a prefix, so one behind max_tiles others is never reached
        place = F.row_number().over(Window.partitionBy("map_id", "deleted").orderBy("seq"))
        some = some.withColumn("__place", place).where(F.col("deleted") | (F.col("__place") <= max_tiles)).drop("__place")
    own = [c for c in changed.columns if c != "map_id"]
    kinds = dict(changed.dtypes)

    def step(taken: dict, row: dict) -> tuple | None:
        points = taken["points"] + (0 if row["deleted"] else row["n_points"])
        held = taken["bytes"] + row["n_bytes"]
        fits = not taken["closed"] and not (max_tiles and taken["tiles"] >= max_tiles) and not (max_points and points > max_points) and not (max_bytes and held > max_bytes)
        if not fits:
            taken["closed"] = taken["closed"] or not row["deleted"]
            return None
        taken.update(tiles=taken["tiles"] + 1, points=points, bytes=held)
        return tuple(row[c] for c in own)

    begin = lambda: {"tiles": 0, "points": 0, "bytes": 0, "closed": False}
    return walked(some, ["map_id"], [F.desc("deleted"), F.col("seq")], begin, step, ", ".join(f"{c} {kinds[c]}" for c in own)).select(*changed.columns)


def voxel_cap(points: DataFrame, most: int, order: list[str]) -> DataFrame:
    """Points of the first ``most`` voxels of each tile by arrival; later points of these voxels count as well."""
    arrival = F.struct(*order)
    first = points.groupBy(*TILE, *VOXEL).agg(F.min(arrival).alias("__first"))
    kept = first.withColumn("__rank", F.row_number().over(Window.partitionBy(*TILE).orderBy("__first", *VOXEL))).where(F.col("__rank") <= most)
    return points.join(kept.select(*TILE, *VOXEL), TILE + VOXEL, "left_semi")


def stop_accumulating(points: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """Points of the first ``budget`` voxels of each map; others came when it was full. Voxels are numbered by a prefix scan,
    so one map is as many tasks as it fills."""
    first = points.groupBy("map_id", *TILE, *VOXEL).agg(F.min(F.struct(*order)).alias("__first"))
    kept = scans.row_numbers(first, ["map_id"], ["__first", *TILE, *VOXEL], "__rank").where(F.col("__rank") <= budget)
    return points.join(kept.select("map_id", *TILE, *VOXEL), ["map_id", *TILE, *VOXEL], "left_semi")


def within_budget(tiles: DataFrame, budget: int, size: str, order: list[Column]) -> DataFrame:
    """Tiles that stay: best first, as long as the sizes up to and with the tile are within the budget. Sizes are added up
    by a prefix scan; an unknown size counts as 0."""
    names = [f"__by_{i}" for i in range(len(order))]
    placed = tiles.withColumns(dict(zip(names, order, strict=True)))
    summed = scans.prefix(placed, ["map_id"], names, {"__sum": F.coalesce(F.col(size).cast("long"), F.lit(0))})
    return summed.where(F.col("__sum") <= budget).drop("__sum", *names)


def retain_lru(tiles: DataFrame, budget: int, size: str = "n_voxels") -> DataFrame:
    """The least recently touched go first. ``tiles(map_id, tx, ty, tz, last_frame, <size>)``."""
    return within_budget(tiles, budget, size, [-F.col("last_frame"), F.col("tx"), F.col("ty"), F.col("tz")])


def retain_near(tiles: DataFrame, budget: int, tile_size: float, at: tuple[Column, Column, Column], size: str = "n_voxels") -> DataFrame:
    """The tiles whose centres are furthest from a position go first; of equal ones the older."""
    d2 = sum((((F.col(t) + 0.5) * tile_size - p) ** 2 for t, p in zip(TILE, at, strict=True)), F.lit(0.0))
    return within_budget(tiles, budget, size, [d2, -F.col("last_frame"), F.col("tx"), F.col("ty"), F.col("tz")])


def newest(rows: DataFrame, most: int, keys: list[str], order: list[str]) -> DataFrame:
    """The newest ``most`` rows of each key."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= most).drop("__n")


def shedding(rows: DataFrame, most: int, keys: list[str]) -> DataFrame:
    """(keys, kept, dropped) when each key's queue keeps its newest ``most``."""
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(F.least(n, F.lit(most)).alias("kept"), F.greatest(n - most, F.lit(0)).cast("bigint").alias("dropped"))


def coalesced(updates: DataFrame) -> DataFrame:
    """The newest version of each tile's updates; of one version, a resync over a plain one."""
    return updates.groupBy(*TILE).agg(F.max_by(F.struct("version", "n_points", "resync"), F.struct("version", "resync")).alias("u")).select(*TILE, "u.*")


def tombstones(evicted: DataFrame, delivered: DataFrame, floor: int = 0) -> DataFrame:
    """Deletions of evicted tiles that a consumer has, with a version above all before."""
    old = delivered.select(*TILE, F.col("version").alias("__delivered"))
    met = evicted.join(old, TILE)
    return met.select(*TILE, F.greatest(F.greatest("version", "__delivered") + 1, F.lit(floor + 1)).cast("bigint").alias("version"), F.lit(True).alias("deleted"))


def resync(tiles: DataFrame) -> DataFrame:
    """All current tiles again, marked for a new consumer."""
    return tiles.withColumn("resync", F.lit(True))


def delta_with_overflow(deltas: DataFrame, bound: int) -> DataFrame:
    """(map_id, frame_id, points, dropped, resync) of per-frame deltas ``(map_id, frame_id, points)``: a delta that doesn't
    fit beside the ones still waiting drops them and asks for a resync. Waiting deltas restart after a drop,
    so frames (one row each) are walked in order by map."""

    def step(held: dict, row: dict) -> tuple:
        waiting, points = held["waiting"], row["points"]
        over = waiting > 0 and waiting + points > bound
        held["waiting"] = points if over else waiting + points
        return row["frame_id"], points, waiting if over else 0, over

    return walked(deltas.select("map_id", "frame_id", "points"), ["map_id"], ["frame_id"], lambda: {"waiting": 0}, step, "frame_id bigint, points bigint, dropped bigint, resync boolean")
