"""Scan-to-map matching: plane fits on neighbours, residual gate, report, normal equations of one step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pivoted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares ``a x = b`` of many small systems (n, rows, 3) by Householder steps, the longest remaining column first.
    A column that is nothing but rounding against the longest one counts as dependent, and its unknown is 0."""
    a, b = a.astype(np.float64).copy(), b.astype(np.float64).copy()
    n, rows, width = a.shape
    every = np.arange(n)
    order = np.tile(np.arange(width), (n, 1))
    diagonal = np.zeros((n, width))
    for i in range(width):
        longest = i + np.argmax((a[:, i:, i:] ** 2).sum(axis=1), axis=1)
        order[every, i], order[every, longest] = order[every, longest].copy(), order[every, i].copy()
        left, right = a[every, :, i].copy(), a[every, :, longest].copy()
        a[every, :, i], a[every, :, longest] = right, left
        v = a[:, i:, i].copy()
        size = np.sqrt((v**2).sum(axis=1))
        v[:, 0] += np.where(v[:, 0] < 0, -size, size)
        scale = (v**2).sum(axis=1)
        v /= np.sqrt(np.where(scale > 0, scale, 1.0))[:, None]
        a[:, i:, i:] -= 2 * v[:, :, None] * np.einsum("nr,nrc->nc", v, a[:, i:, i:])[:, None, :]
        b[:, i:] -= 2 * v * np.einsum("nr,nr->n", v, b[:, i:])[:, None]
        diagonal[:, i] = a[:, i, i]
    sure = np.abs(diagonal) > np.abs(diagonal[:, :1]) * max(rows, width) * np.finfo(np.float64).eps
    out = np.zeros((n, width))
    for i in reversed(range(width)):
        rest = b[:, i] - np.einsum("nc,nc->n", a[:, i, i + 1 :], out[:, i + 1 :])
        out[:, i] = np.where(sure[:, i], rest / np.where(sure[:, i], diagonal[:, i], 1.0), 0.0)
    x = np.zeros((n, width))
    np.put_along_axis(x, order, out, axis=1)
    return x


_PLANE = ("a", "b", "c", "d", "worst")


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in _PLANE]))
def _plane(lists: pa.Array) -> pa.Array:
    """Of each list of points the plane ``n . p = -1`` with a unit normal, and the largest distance from it; null for a null
    list, and where no plane can be told."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    found = np.full((len(lists), 5), np.nan)
    for rows in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == rows)
        flat = lists.take(pa.array(own)).flatten()
        points = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).reshape(len(own), rows, 3)
        n = pivoted(points, -np.ones((len(own), rows)))
        long = np.sqrt((n**2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            unit, d = n / long[:, None], 1 / long
            worst = np.abs(np.einsum("nrc,nc->nr", points, unit) + d[:, None]).max(axis=1)
        found[own] = np.column_stack([unit, d, worst])
    known = np.isfinite(found).all(axis=1)
    return pa.StructArray.from_arrays([pa.array(found[:, i], mask=~known) for i in range(5)], names=list(_PLANE))


def planes(near: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``near(query_id, points array<struct<x, y, z>>, ...)`` with (a, b, c, d, worst, accepted): the plane ``n . p = -1`` by
    least squares, scaled to a unit normal; accepted if no point is further than ``threshold`` from it.

    Solved by pivoted Householder steps on the points themselves, which keeps what normal equations lose where points are
    nearly on a line or their plane is nearly through the origin. Systems of a batch are solved side by side.
    """
    fitted = near.withColumn("__plane", _plane("points"))
    told = fitted.select(*near.columns, *(F.col(f"__plane.{c}").alias(c) for c in _PLANE))
    return told.withColumn("accepted", F.coalesce(F.col("worst") <= threshold, F.lit(False)))


def residual_accepted(residual: Column, body_norm: Column) -> Column:
    """``1 - 0.9 |d| / sqrt(|p_body|) > 0.9`` for a norm above 0."""
    return (body_norm > 0) & (1 - 0.9 * F.abs(residual) / F.sqrt(body_norm) > 0.9)


def residuals(fits: DataFrame) -> DataFrame:
    """Fits (query_id, frame_id, qx, qy, qz in the world, body_norm, plane) that are accepted and whose query is near enough
    to the plane, with ``residual``."""
    d = F.col("a") * F.col("qx") + F.col("b") * F.col("qy") + F.col("c") * F.col("qz") + F.col("d")
    return fits.where("accepted").withColumn("residual", d).where(residual_accepted(F.col("residual"), F.col("body_norm")))


def match_report(matched: DataFrame) -> DataFrame:
    return matched.groupBy("frame_id").agg(F.count(F.lit(1)).alias("effective"), F.sum(F.abs("residual")).alias("total_residual"), F.avg(F.abs("residual")).alias("mean_residual"))


def jacobian(normal: list[Column], point: list[Column], rotation: list[Column]) -> list[Column]:
    """Row of a point-to-plane residual: the normal, then ``p x (R' n)``. ``point`` is in the body frame."""
    from pointloom.functions import geometry as g

    c = g.apply(g.transpose(rotation), normal)
    return [*normal, *g.cross(point, c)]


def normal_equations(matched: DataFrame, rows: list[Column], key: str = "frame_id") -> DataFrame:
    """Upper triangle of H'H (h_ij) and H'r (g_i) of each frame, as 27 sums."""
    h = matched.select(key, "residual", *(r.alias(f"j{i}") for i, r in enumerate(rows)))
    n = len(rows)
    return h.groupBy(key).agg(
        *(F.sum(F.col(f"j{i}") * F.col(f"j{k}")).alias(f"h_{i}{k}") for i in range(n) for k in range(i, n)), *(F.sum(-F.col(f"j{i}") * F.col("residual")).alias(f"g_{i}") for i in range(n)), F.count(F.lit(1)).alias("n")
    )


def solved(equations: DataFrame, damping: float = 1e-6, key: str = "frame_id", n: int = 6) -> DataFrame:
    """One Gauss-Newton step of each frame: (key, d_0 .. d_5). A frame is one row; its system is solved in numpy."""
    import pandas as pd

    kind = dict(equations.dtypes)[key]

    def solve(parts):
        for pdf in parts:
            h = np.zeros((len(pdf), n, n))
            for i in range(n):
                for k in range(i, n):
                    h[:, i, k] = h[:, k, i] = pdf[f"h_{i}{k}"]
            d = np.linalg.solve(h + damping * np.eye(n), pdf[[f"g_{i}" for i in range(n)]].to_numpy()[:, :, None])[:, :, 0] if len(pdf) else np.zeros((0, n))
            yield pd.concat([pdf[[key]].reset_index(drop=True), pd.DataFrame(d, columns=[f"d_{i}" for i in range(n)])], axis=1)

    return equations.mapInPandas(solve, f"{key} {kind}, " + ", ".join(f"d_{i} double" for i in range(n)))
