"""Inertial samples and motion: rest statistics, midpoints, motion compensation, open-loop integration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import geometry as g
from pointloom.operators import scans


def rest_statistics(samples: DataFrame, keys: list[str], order: list[str], axes: tuple = ("ax", "ay", "az", "gx", "gy", "gz"), least: int = 10) -> DataFrame:
    """Mean and variance of samples at rest, gravity and gyro bias, and whether there were enough samples.

    The variance is the recurrence's closed form: with the running mean m_k after sample k,
    ``sum((x_k - m_k)^2 (k - 1) / k) / N``. Running means come from a prefix scan, so one device is many tasks. Gravity points against the mean acceleration.
    """
    own = {"__k": F.lit(1).cast("long"), **{f"__m_{a}": F.coalesce(F.col(a).cast("double"), F.lit(0.0)) for a in axes}}
    means = scans.prefix(samples.select(*keys, *order, *(a for a in axes if a not in order)), keys, order, own)
    parts = [((F.col(a) - F.col(f"__m_{a}") / F.col("__k")) ** 2 * (F.col("__k") - 1) / F.col("__k")).alias(f"__q_{a}") for a in axes]
    summed = means.select(*keys, *axes, *parts).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(f"mean_{a}") for a in axes), *((F.sum(f"__q_{a}") / F.count(F.lit(1))).alias(f"cov_{a}") for a in axes))
    acc = [F.col(f"mean_{a}") for a in axes[:3]]
    size = g.norm(acc)
    return summed.select("*", *((F.try_divide(-m, size) * g.GRAVITY).alias(f"grav_{a}") for m, a in zip(acc, "xyz", strict=True)), (F.col("n") >= least).alias("done"))


def normalised_acc(acc: Column, mean_norm: Column) -> Column:
    return F.try_divide(acc * g.GRAVITY, mean_norm)


def from_g(acc: Column) -> Column:
    """g to m/s^2, as live input has it."""
    return acc * g.STANDARD_GRAVITY


def midpoints(samples: DataFrame, keys: list[str], axes: tuple, frame_end: str | None = None, time: str = "ts_us") -> DataFrame:
    """Means of each sample and the next one, and the time between them, counted from the last frame's end at
    the earliest. Pairs that end before it are left out."""
    order = Window.partitionBy(*keys).orderBy(time, "seq")
    nxt = {c: F.lead(c).over(order) for c in (time, *axes)}
    paired = samples.select(*keys, "seq", time, F.col(frame_end).alias("__end") if frame_end else F.lit(None).cast("bigint").alias("__end"), nxt[time].alias("tail_us"), *(((F.col(a) + nxt[a]) * 0.5).alias(f"{a}_mid") for a in axes))
    begin = F.greatest(F.col(time), F.coalesce("__end", F.col(time)))
    kept = paired.where(F.col("tail_us").isNotNull() & (F.col("__end").isNull() | (F.col("tail_us") >= F.col("__end"))))
    return kept.select(*keys, "seq", time, "tail_us", *(f"{a}_mid" for a in axes), ((F.col("tail_us") - begin) / 1e6).alias("dt_s"))


def compensated(point: g.Vector, dt: Column, rotation: g.Matrix, velocity: g.Vector, position: g.Vector, acc: g.Vector, rate: g.Vector, end_rotation: g.Matrix, end_position: g.Vector, mount: g.Matrix | None = None, lever: g.Vector | None = None) -> g.Vector:
    """A point moved to the frame's end: at constant acceleration and turn rate since the pose before it."""
    zero = [F.lit(0.0)] * 3
    mount, lever = mount or g.identity(), lever or zero
    now = g.multiply(rotation, g.exp(rate, dt))
    shift = [p + v * dt + 0.5 * a * dt * dt - e for p, v, a, e in zip(position, velocity, acc, end_position, strict=True)]
    body = [a + b for a, b in zip(g.apply(mount, point), lever, strict=True)]
    world = [a + b for a, b in zip(g.apply(now, body), shift, strict=True)]
    back = [a - b for a, b in zip(g.apply(g.transpose(end_rotation), world), lever, strict=True)]
    return g.apply(g.transpose(mount), back)


_TURN, _SPEED, _WAY = ("__qw", "__qx", "__qy", "__qz"), ("__vx", "__vy", "__vz"), ("__px", "__py", "__pz")


def _product(a: list, b: list) -> list:
    """Quaternion product, of numbers, arrays or columns."""
    return [
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ]


def _turned(q: list, v: list) -> list:
    """``v`` turned by the unit quaternion ``q``."""
    w, u = q[0], q[1:]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    once = [c + c for c in cross(u, v)]
    return [x + w * y + z for x, y, z in zip(v, once, cross(u, once), strict=True)]


def stepped(a: dict, b: dict) -> dict:
    """Two stretches of open-loop motion, one after the other: what the second turned, gained and moved in its own frame is
    turned into the first one's. Associative, not commutative. ``__t`` is the time, ``__s`` the sum of the time before each
    step times the step, by which gravity's pull moves."""
    q, v, p = ([a[c] for c in names] for names in (_TURN, _SPEED, _WAY))
    gained, moved = _turned(q, [b[c] for c in _SPEED]), _turned(q, [b[c] for c in _WAY])
    turn = _product(q, [b[c] for c in _TURN])
    return {
        **dict(zip(_TURN, turn, strict=True)), **{c: x + y for c, x, y in zip(_SPEED, v, gained, strict=True)}, **{c: x + s * b["__t"] + y for c, x, s, y in zip(_WAY, p, v, moved, strict=True)},
        "__t": a["__t"] + b["__t"], "__s": a["__s"] + a["__t"] * b["__t"] + b["__s"],
    }


def integrated(steps: DataFrame, keys: list[str], order: str, gravity: tuple = (0.0, 0.0, -g.GRAVITY), parts: int | None = None) -> DataFrame:
    """Open-loop poses of ``steps(keys, order, dt, ax, ay, az, gx, gy, gz)``, from rest at the origin.

    A stretch of steps is one element (turn, gain of velocity, way, time), and elements combine associatively, so poses are
    a prefix scan: a segment of any length is as many tasks as it fills. A step turns by its rates, gains its acceleration
    in the frame that held before it, and moves by the velocity that held before it. Values that are null count as 0.
    """
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("dt", "ax", "ay", "az", "gx", "gy", "gz")}
    size = g.norm([value[f"g{c}"] for c in "xyz"])
    half = F.when(size > 1e-7, size * value["dt"] / 2).otherwise(0.0)
    axis = [F.when(size > 1e-7, F.sin(half) * value[f"g{c}"] / size).otherwise(0.0) for c in "xyz"]
    own = {
        **dict(zip(_TURN, [F.cos(half), *axis], strict=True)), **{v: value[f"a{c}"] * value["dt"] for v, c in zip(_SPEED, "xyz", strict=True)}, **dict.fromkeys(_WAY, F.lit(0.0)),
        "__t": value["dt"], "__s": F.lit(0.0),
    }
    found = scans.prefix(steps.select(*keys, order, *value), keys, [order], own, stepped, parts)
    matrix = g.from_quaternion([F.col(c) for c in (*_TURN[1:], _TURN[0])])
    return found.select(
        *keys, order, *((F.col(p) + pull * F.col("__s")).alias(f"p{c}") for p, c, pull in zip(_WAY, "xyz", gravity, strict=True)),
        *((F.col(v) + pull * F.col("__t")).alias(f"v{c}") for v, c, pull in zip(_SPEED, "xyz", gravity, strict=True)), *(x.alias(f"r{i}") for i, x in enumerate(matrix)),
    )
