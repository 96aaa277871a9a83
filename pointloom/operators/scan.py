"""Scan features along a line: geometry and local labels as windows, plane runs as grouped maps, surface averaging.

Labels: 0 none, 1 possible plane, 2 plane, 3 jump edge, 4 plane edge, 5 wire.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE, MAYBE_PLANE, PLANE, JUMP, PLANE_EDGE, WIRE = range(6)
#: How a point's neighbour on one side is seen.
NORMAL, TOWARD, AWAY, INFINITE, HIDDEN = range(5)


@dataclass(frozen=True)
class Limits:
    """Thresholds of the labels (fixed values)."""

    blind: float = 0.01
    group: int = 8
    dis_a: float = 0.01
    dis_b: float = 0.1
    ratio: float = 225.0
    max_mid: float = 6.25
    mid_min: float = 6.25
    far: float = 10.0
    up: float = math.cos(math.radians(170.0))
    down: float = math.cos(math.radians(8.0))
    cross: float = math.cos(math.radians(160.0))
    edge_a: float = 2.0
    edge_b: float = 0.1
    flat: float = math.cos(math.radians(172.5))
    flat_ratio: float = 1.2
    gap: float = 0.0225


def geometry(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds to each point of a line: range in the plane, gap to the next and from the last point, cosines of the angles
    between its ray and its neighbours, and of the angle at which both neighbours are seen from it."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = [F.col(c) for c in "xyz"]
    placed = points.select("*", *(F.lag(c).over(w).alias(f"p{c}") for c in "xyz"), *(F.lead(c).over(w).alias(f"n{c}") for c in "xyz"))
    to = {s: [F.col(f"{s}{c}") - F.col(c) for c in "xyz"] for s in "pn"}
    size = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    safe = lambda d: F.when(d != 0, d)
    measured = placed.select(
        *points.columns, F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("range"), F.coalesce(size(to["n"]), F.lit(0.0)).alias("gap"), size(to["p"]).alias("gap_before"),
        (dot(own, to["p"]) / safe(size(own)) / safe(size(to["p"]))).alias("angle_prev"), (dot(own, to["n"]) / safe(size(own)) / safe(size(to["n"]))).alias("angle_next"),
        (dot(to["p"], to["n"]) / safe(size(to["p"])) / safe(size(to["n"]))).alias("intersect"),
    )
    return measured


def local_labels(measured: DataFrame, keys: list[str], order: str, limits: Limits = Limits()) -> DataFrame:
    """Jump edges and wires of points that no plane run took: a rule on two neighbours to each side."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = {f"{c}{k:+d}": F.lag(c, -k).over(w) for c in ("range", "gap") for k in (-2, -1, 1, 2)}
    row, count = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = measured.select("*", *(v.alias(f"__{k}") for k, v in near.items()), row.alias("__row"), count.alias("__count"))
    n = {k: F.col(f"`__{k}`") for k in near}

    def seen(side: int, angle: str) -> Column:
        hidden = n[f"range{side:+d}"] < limits.blind
        return F.when(hidden & (F.col("range") > limits.far), INFINITE).when(hidden, HIDDEN).when(F.col(angle) < limits.up, AWAY).when(F.col(angle) > limits.down, TOWARD).otherwise(NORMAL)

    def even(side: int) -> Column:
        """Gaps on a side are alike, and neither of its two points is hidden."""
        a, b = (n["gap-1"], n["gap-2"]) if side < 0 else (F.col("gap"), n["gap+1"])
        big, small = F.sqrt(F.greatest(a, b)), F.sqrt(F.least(a, b))
        visible = (n[f"range{side:+d}"] >= limits.blind) & (n[f"range{2 * side:+d}"] >= limits.blind)
        return visible & ~((big > limits.edge_a * small) | (big - small > limits.edge_b))

    p, q = F.col("__prev"), F.col("__next")
    seen_at = at.withColumn("__prev", seen(-1, "angle_prev")).withColumn("__next", seen(1, "angle_next"))
    before, gap = n["gap-1"], F.col("gap")
    usable = (F.col("__row") > 3) & (F.col("__row") <= F.col("__count") - 3) & (F.col("range") >= limits.blind) & (before >= 1e-16) & (gap >= 1e-16)
    jump_next = (p == NORMAL) & (q == TOWARD) & (gap > limits.gap) & (gap > 4 * before)
    jump_prev = (p == TOWARD) & (q == NORMAL) & (before > limits.gap) & (before > 4 * gap)
    wide = F.col("intersect") > limits.cross
    label = (
        F.when(~usable, NONE)
        .when(jump_next, F.when(wide & even(-1), JUMP).otherwise(NONE))
        .when(jump_prev, F.when(wide & even(1), JUMP).otherwise(NONE))
        .when((p == NORMAL) & (q == INFINITE), F.when(even(-1), JUMP).otherwise(NONE))
        .when((p == INFINITE) & (q == NORMAL), F.when(even(1), JUMP).otherwise(NONE))
        .when((p > NORMAL) & (q > NORMAL), WIRE)
        .otherwise(NONE)
    )
    return seen_at.withColumn("label", label).select(*measured.columns, "label")


def plane_run(points: np.ndarray, ranges: np.ndarray, gaps: np.ndarray, start: int, limits: Limits) -> tuple[bool, int, np.ndarray]:
    """Whether a plane starts here, where the run ends, and its direction (zero where there is none)."""
    none, n = np.zeros(3), len(points)
    reach = (limits.dis_a * ranges[start] + limits.dis_b) ** 2
    away = points[start:] - points[start]
    square = (away * away).sum(axis=1)
    over = np.flatnonzero(square[limits.group :] >= reach)
    end = start + limits.group + int(over[0]) if len(over) else n
    hidden = np.flatnonzero(ranges[start : min(end + 1, n)] < limits.blind)
    if len(hidden):
        return False, start + int(hidden[0]), none
    last = min(end, n - 1) - start
    inner = away[1 : end - start]
    spread = np.cross(inner, away[last])
    width = float((spread * spread).sum(axis=1).max(initial=0.0))
    if width > 0 and square[last] ** 2 / width < limits.ratio:
        return False, end, none
    sizes = np.sort(gaps[start:end])[::-1]
    least = sizes[-2]
    if least < 1e-16:
        return False, end, none
    middle = sizes[len(sizes) // 2]
    if sizes[0] / middle >= limits.max_mid or middle / least >= limits.mid_min:
        return False, end, none
    return True, end, away[last] / max(np.sqrt(square[last]), 1e-300)


def plane_labels(points: np.ndarray, ranges: np.ndarray, gaps: np.ndarray, limits: Limits) -> np.ndarray:
    """Labels of plane runs along a line, and of the edge where two runs meet at an angle."""
    n = len(points)
    label = np.zeros(n, dtype=np.int32)
    at, before, direction = int(np.argmax(ranges >= limits.blind)) if (ranges >= limits.blind).any() else n, False, np.zeros(3)
    while at < n - limits.group:
        if ranges[at] < limits.blind:
            at += 1
            continue
        plane, end, now = plane_run(points, ranges, gaps, at, limits)
        if plane:
            last = min(end, n - 1)
            label[at + 1 : last] = PLANE
            label[[at, last]] = MAYBE_PLANE
            if before and np.linalg.norm(direction) > 0.1:
                label[at] = PLANE_EDGE if -0.707 < float(direction @ now) < 0.707 else PLANE
            at = end
        else:
            at = end + 1
        before, direction = plane, now
    return label


def scan_labels(measured: DataFrame, keys: list[str], order: str, limits: Limits = Limits()) -> DataFrame:
    """All labels: plane runs, then local ones where no run is, then points flat between even gaps.

    A run's start depends on the end of the one before, so each line (a small group) is labelled in its own map.
    """
    kinds, names = dict(measured.dtypes), measured.columns
    local = local_labels(measured, keys, order, limits)

    def label(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable").reset_index(drop=True)
        points, ranges, gaps = group[["x", "y", "z"]].to_numpy(), group["range"].to_numpy(), group["gap"].to_numpy()
        found = plane_labels(points, ranges, gaps, limits)
        free = found < PLANE
        found = np.where(free & (group["label"].to_numpy() == JUMP), JUMP, np.where((found == NONE) & (group["label"].to_numpy() == WIRE), WIRE, found))
        bend = group["intersect"].to_numpy(dtype=float)
        for i in range(1, len(found) - 1):
            if found[i] != NONE or min(ranges[i - 1 : i + 2]) < limits.blind or min(gaps[i - 1], gaps[i]) < 1e-8:
                continue
            if bend[i] < limits.flat and max(gaps[i - 1], gaps[i]) / min(gaps[i - 1], gaps[i]) < limits.flat_ratio:
                near = found[i - 1 : i + 2]
                near[near == NONE] = PLANE
        return group.assign(label=found.astype("int32"))[[*names, "label"]]

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", label int"
    return local.groupBy(*keys).applyInPandas(label, schema)


def surface_points(labelled: DataFrame, keys: list[str], order: str, every: int) -> DataFrame:
    """(keys, kind, x, y, z, n): of each run of surface points every ``every``-th; of what is left before another label the
    mean; jump and plane edges as corners. A rest at a line's end goes."""
    w = Window.partitionBy(*keys).orderBy(order)
    surface = F.col("label").isin(MAYBE_PLANE, PLANE)
    runs = labelled.withColumn("__run", F.sum((~surface).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__closed", F.max((~surface).cast("int") * F.row_number().over(w)).over(Window.partitionBy(*keys)) > F.row_number().over(w))
    spots = runs.where(surface).withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(order)) - 1)
    parts = spots.withColumn("__part", F.floor(F.col("__k") / every)).groupBy(*keys, "__run", "__part")
    grouped = parts.agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("x", "y", "z"), order).alias("last"), *(F.avg(c).alias(c) for c in "xyz"), F.min("__closed").alias("closed"))
    whole = F.col("n") == every
    kept = grouped.where(whole | F.col("closed")).select(*keys, F.lit("surface").alias("kind"), *(F.when(whole, F.col(f"last.{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"), "n")
    corners = labelled.where(F.col("label").isin(JUMP, PLANE_EDGE)).select(*keys, F.lit("corner").alias("kind"), "x", "y", "z", F.lit(1).cast("bigint").alias("n"))
    return kept.unionByName(corners)
