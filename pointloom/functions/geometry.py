"""Rotations as column algebra. A matrix is a list of nine columns, row by row; a vector a list of three."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The conversion constants whose digits results depend on.
PI_M = 3.14159265358
DEGREES_Q = 57.3
GRAVITY, STANDARD_GRAVITY = 9.81, 9.80665

Vector = list[Column]
Matrix = list[Column]


def degrees(rad: Column) -> Column:
    return rad * (180.0 / PI_M)


def radians(deg: Column) -> Column:
    return deg * (PI_M / 180.0)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Vector, b: Vector) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(F.try_divide(dot(a, b), norm(a)), norm(b))


def squared_distance(a: Vector, b: Vector) -> Column:
    d = [p - q for p, q in zip(a, b, strict=True)]
    return dot(d, d)


def skew(v: Vector) -> Matrix:
    zero = F.lit(0.0)
    return [zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return [sum((a[3 * i + k] * b[3 * k + j] for k in (1, 2)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]


def transpose(a: Matrix) -> Matrix:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def apply(a: Matrix, v: Vector) -> Vector:
    return [dot(a[3 * i : 3 * i + 3], v) for i in range(3)]


def identity() -> Matrix:
    return [F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)]


def exp(rate: Vector, dt: Column | None = None) -> Matrix:
    """Rotation about ``rate`` for ``dt``; the identity below 1e-7 (with dt) or 1e-5 (an angle vector) in size."""
    size = norm(rate)
    least = 1e-5 if dt is None else 1e-7
    safe = F.when(size > least, size).otherwise(1.0)
    k = skew([r / safe for r in rate])
    k2 = multiply(k, k)
    angle = size if dt is None else size * dt
    one = identity()
    return [F.when(size > least, one[i] + F.sin(angle) * k[i] + (1.0 - F.cos(angle)) * k2[i]).otherwise(one[i]) for i in range(9)]


def log(r: Matrix) -> Vector:
    """Angle vector; no rotation where the trace is above 3 - 1e-6."""
    trace = r[0] + r[4] + r[8]
    theta = F.when(trace > 3.0 - 1e-6, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (trace - 1)))))
    k = [r[7] - r[5], r[2] - r[6], r[3] - r[1]]
    scale = F.when(F.abs(theta) < 0.001, 0.5).otherwise(0.5 * theta / F.sin(theta))
    return [scale * v for v in k]


def euler(r: Matrix) -> Vector:
    """Roll, pitch, yaw in radians; roll from the second column and yaw 0 where the pitch is at a pole."""
    sy = F.sqrt(r[0] * r[0] + r[3] * r[3])
    pole = sy < 1e-6
    return [F.when(pole, F.atan2(-r[5], r[4])).otherwise(F.atan2(r[7], r[8])), F.atan2(-r[6], sy), F.when(pole, 0.0).otherwise(F.atan2(r[3], r[0]))]


def quaternion_euler(q: Vector) -> Vector:
    """Degrees (by the factor 57.3) of a quaternion x, y, z, w; poles at 0.49999 of its square."""
    x, y, z, w = q
    unit = x * x + y * y + z * z + w * w
    test = w * y - z * x
    half = F.pi() / 2
    up, down = test > 0.49999 * unit, test < -0.49999 * unit
    roll = F.when(up, 2 * F.atan2(x, w)).when(down, -2 * F.atan2(x, w)).otherwise(F.atan2(2 * x * w + 2 * y * z, -x * x - y * y + z * z + w * w))
    pitch = F.when(up, half).when(down, -half).otherwise(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(2 * test, unit)))))
    yaw = F.when(up | down, 0.0).otherwise(F.atan2(2 * z * w + 2 * y * x, x * x - y * y - z * z + w * w))
    return [v * DEGREES_Q for v in (roll, pitch, yaw)]


def from_quaternion(q: Vector) -> Matrix:
    x, y, z, w = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def to_quaternion(r: Matrix) -> Vector:
    """x, y, z, w; from the trace where it is positive, else from the largest diagonal entry."""
    trace = r[0] + r[4] + r[8]
    s0, s1 = 2 * F.sqrt(F.greatest(trace + 1, F.lit(1e-300))), 2 * F.sqrt(F.greatest(1 + r[0] - r[4] - r[8], F.lit(1e-300)))
    s2, s3 = 2 * F.sqrt(F.greatest(1 + r[4] - r[0] - r[8], F.lit(1e-300))), 2 * F.sqrt(F.greatest(1 + r[8] - r[0] - r[4], F.lit(1e-300)))
    cases = [
        ((r[7] - r[5]) / s0, 0.25 * s1, (r[1] + r[3]) / s2, (r[2] + r[6]) / s3),
        ((r[2] - r[6]) / s0, (r[1] + r[3]) / s1, 0.25 * s2, (r[5] + r[7]) / s3),
        ((r[3] - r[1]) / s0, (r[2] + r[6]) / s1, (r[5] + r[7]) / s2, 0.25 * s3),
        (0.25 * s0, (r[7] - r[5]) / s1, (r[2] - r[6]) / s2, (r[3] - r[1]) / s3),
    ]
    first, second = (r[0] > r[4]) & (r[0] > r[8]), r[4] > r[8]
    return [F.when(trace > 0, a).when(first, b).when(second, c).otherwise(d) for a, b, c, d in cases]


def rotation_z(yaw: Column) -> Matrix:
    c, s, o, one = F.cos(yaw), F.sin(yaw), F.lit(0.0), F.lit(1.0)
    return [c, -s, o, s, c, o, o, o, one]


def to_world(p: Vector, rotation: Matrix, position: Vector, mount: Matrix | None = None, lever: Vector | None = None) -> Vector:
    """A point of the sensor's frame in the world: ``R (R_mount p + t_mount) + t``."""
    body = apply(mount, p) if mount else p
    if lever:
        body = [a + b for a, b in zip(body, lever, strict=True)]
    return [a + b for a, b in zip(apply(rotation, body), position, strict=True)]


def box_plus(rotation: Matrix, position: Vector, d_rotation: Vector, d_position: Vector) -> tuple[Matrix, Vector]:
    """A pose moved by a small step: rotation by ``R Exp(d)``, position by addition."""
    return multiply(rotation, exp(d_rotation)), [a + b for a, b in zip(position, d_position, strict=True)]


def box_minus(r1: Matrix, p1: Vector, r2: Matrix, p2: Vector) -> tuple[Vector, Vector]:
    """The step from the second pose to the first."""
    return log(multiply(transpose(r2), r1)), [a - b for a, b in zip(p1, p2, strict=True)]


def ros_seconds(sec: Column, nsec: Column) -> Column:
    return sec.cast("double") + nsec / 1e9


def ros_time(seconds: Column) -> tuple[Column, Column]:
    """(sec, nsec) of seconds, both cut off."""
    sec = F.floor(seconds).cast("bigint")
    return sec, ((seconds - sec) * 1e9).cast("bigint")


def ns_parts(ns: Column) -> tuple[Column, Column]:
    return F.floor(ns / 1_000_000_000).cast("bigint"), (ns % 1_000_000_000).cast("bigint")


def clamp_u8(value: Column) -> Column:
    """Rounded half away from zero into 0..255; 0 for what is not finite."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    held = F.greatest(F.lit(-1.0), F.least(F.lit(256.0), value))
    return F.when(bad, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.round(held).cast("int"))))


def intensity_colour(intensity: Column) -> Vector:
    """Red, green, blue, alpha of the ramp from blue to yellow."""
    n = F.greatest(F.lit(0.0), F.least(F.lit(1.0), intensity / 255.0))
    return [n, 0.35 + 0.45 * n, 1.0 - 0.65 * n, F.lit(0.9)]
