"""Map state by key (``transformWithState``): each voxel of a tile is a state row of its own.

State is kept by RocksDB, so what a batch doesn't touch is neither read nor written, and a tile may have any number of
voxels. A batch reads, changes and emits the voxels that it touches, and one head row a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELL = "frame_id long, idx long, n long, x double, y double, z double, intensity double"
TILE_CELL = f"tx int, ty int, tz int, version long, n_points long, n_voxels long, vx int, vy int, vz int, {CELL}"
_VOXEL, _VALUES = ["vx", "vy", "vz"], ["x", "y", "z", "intensity"]


def on_rocks(spark: SparkSession) -> None:
    """Map state needs this store; a query that was started keeps the one that its checkpoint names."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class TileCells(StatefulProcessor):
    """Cells of one tile under a policy: ``first`` and ``latest`` keep a point, ``centroid`` sums of all points."""

    def __init__(self, policy: str):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "version long, n_points long, n_voxels long, last_frame long")
        self.cells = handle.getMapState("cells", "vx int, vy int, vz int", CELL)

    def _of_batch(self, rows: pd.DataFrame) -> dict[tuple, tuple]:
        """One cell a voxel of some rows."""
        rows = rows.sort_values(["frame_id", "idx"], kind="stable")
        by_voxel = rows.groupby(_VOXEL, sort=False)
        cells = (by_voxel.head(1) if self.policy == "first" else by_voxel.tail(1)).set_index(_VOXEL)
        cells["n"] = by_voxel.size()
        if self.policy == "centroid":
            cells[_VALUES] = by_voxel[_VALUES].sum()
        return {tuple(map(int, k)): (int(f), int(i), int(n), *map(float, v)) for k, f, i, n, *v in zip(cells.index, *(cells[c] for c in ("frame_id", "idx", "n", *_VALUES)), strict=True)}

    def _joined(self, old: tuple, new: tuple) -> tuple:
        later = new[:2] > old[:2]
        if self.policy == "centroid":
            return (*max(old[:2], new[:2]), old[2] + new[2], *(a + b for a, b in zip(old[3:], new[3:], strict=True)))
        kept = new if later == (self.policy == "latest") else old
        return (*kept[:2], old[2] + new[2], *kept[3:])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, n_points, n_voxels, last_frame = self.head.get() if self.head.exists() else (0, 0, 0, None)
        frames, touched = set(), {}
        for part in rows:  # of a batch's rows only one cell a voxel is held
            n_points += len(part)
            frames |= set(part["frame_id"].tolist())
            for voxel, cell in self._of_batch(part).items():
                touched[voxel] = self._joined(touched[voxel], cell) if voxel in touched else cell
        out, opened = [], set()
        for voxel, cell in touched.items():
            if self.cells.containsKey(voxel):
                cell = self._joined(tuple(self.cells.getValue(voxel)), cell)
            else:
                n_voxels += 1
                opened.add(cell[0])
            self.cells.updateValue(voxel, cell)
            out.append((*voxel, *cell))
        counted = (opened if self.policy == "first" else frames) - {last_frame}
        version, last_frame = version + len(counted), max(counted, default=last_frame)
        self.head.update((version, n_points, n_voxels, last_frame))
        found = pd.DataFrame(out, columns=[*_VOXEL, "frame_id", "idx", "n", *_VALUES])
        if self.policy == "centroid":
            found[_VALUES] = found[_VALUES].div(found["n"], axis=0)
        for c, v in zip(("tx", "ty", "tz", "version", "n_points", "n_voxels"), (*key, version, n_points, n_voxels), strict=True):
            found[c] = v
        yield found[[c.split()[0] for c in TILE_CELL.split(", ")]]

    def close(self) -> None:
        pass


def tile_cells(points: DataFrame, policy: str = "latest") -> DataFrame:
    """The tiled map, kept up with ``points(tx, ty, tz, vx, vy, vz, frame_id, idx, x, y, z, intensity)``: of each batch the voxels
    that it touched, as they are now, with their tile's version, points and voxels. Frames come in order; one may go on in
    the next batch. The version rises with each frame that changed the tile (``first``: that opened a voxel)."""
    if policy not in ("first", "latest", "centroid"):
        raise ValueError(f"unknown policy {policy}")
    on_rocks(points.sparkSession)
    return points.groupBy("tx", "ty", "tz").transformWithStateInPandas(TileCells(policy), TILE_CELL, "Update", "None")


class BoundedQueue(StatefulProcessor):
    """A consumer's queue with a bound: what waits in it is the state."""

    def __init__(self, bound: int):
        self.bound = bound

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", "points long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = self.waiting.get()[0] if self.waiting.exists() else 0
        parts = pd.concat([p[["frame_id", "points"]] for p in rows]).sort_values("frame_id", kind="stable")  # two numbers a frame
        dropped, over = [], []
        for n in parts["points"].tolist():
            full = waiting > 0 and waiting + n > self.bound
            dropped.append(waiting if full else 0)
            over.append(full)
            waiting = n if full else waiting + n
        self.waiting.update((int(waiting),))
        yield parts.assign(map_id=key[0], dropped=dropped, resync=over)[["map_id", "frame_id", "points", "dropped", "resync"]]

    def close(self) -> None:
        pass


def delta_queue(deltas: DataFrame, bound: int) -> DataFrame:
    """As :func:`pointloom.operators.tiles.delta_with_overflow`, for a stream of ``deltas(map_id, frame_id, points)``: a delta that
    doesn't fit beside those that wait drops them and asks for one resync. Frames come in order, cut into batches anywhere."""
    on_rocks(deltas.sparkSession)
    return deltas.groupBy("map_id").transformWithStateInPandas(BoundedQueue(bound), "map_id long, frame_id long, points long, dropped long, resync boolean", "Append", "None")
