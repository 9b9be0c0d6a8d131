"""Frames, rigid transforms, camera geometry and colour as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = 2 * math.pi


def wrap_angle(a: Column) -> Column:
    """Into [-pi, pi) by the floored remainder."""
    return F.pmod(a + F.lit(math.pi), F.lit(TURN)) - F.lit(math.pi)


def se2(x: Column, y: Column, theta: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), theta.alias("theta"))


def compose(a: Column, b: Column) -> Column:
    """First b, then a."""
    c, s = F.cos(a["theta"]), F.sin(a["theta"])
    return se2(a["x"] + c * b["x"] - s * b["y"], a["y"] + s * b["x"] + c * b["y"], wrap_angle(a["theta"] + b["theta"]))


def inverse(a: Column) -> Column:
    c, s = F.cos(a["theta"]), F.sin(a["theta"])
    return se2(-c * a["x"] - s * a["y"], s * a["x"] - c * a["y"], wrap_angle(-a["theta"]))


def relative(a: Column, b: Column) -> Column:
    """b as seen from a."""
    return compose(inverse(a), b)


def apply_se2(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    c, s = F.cos(t["theta"]), F.sin(t["theta"])
    return t["x"] + c * x - s * y, t["y"] + s * x + c * y


def rotate_uv(x: Column, z: Column, theta: Column) -> tuple[Column, Column]:
    c, s = F.cos(theta), F.sin(theta)
    return x * c + z * s, z * c - x * s


def unrotate_uv(u: Column, v: Column, theta: Column) -> tuple[Column, Column]:
    c, s = F.cos(theta), F.sin(theta)
    return u * c - v * s, u * s + v * c


def quaternion_rows(qx: Column, qy: Column, qz: Column, qw: Column) -> list[list[Column]]:
    """The rotation of a quaternion of any positive length; a zero one is an error."""
    n2 = qx * qx + qy * qy + qz * qz + qw * qw
    n2 = F.when(n2 > 0, n2).otherwise(F.raise_error(F.lit("a quaternion has length zero")).cast("double"))
    k = F.lit(2.0) / n2
    one = F.lit(1.0)
    return [
        [one - k * (qy * qy + qz * qz), k * (qx * qy - qz * qw), k * (qx * qz + qy * qw)],
        [k * (qx * qy + qz * qw), one - k * (qx * qx + qz * qz), k * (qy * qz - qx * qw)],
        [k * (qx * qz - qy * qw), k * (qy * qz + qx * qw), one - k * (qx * qx + qy * qy)],
    ]


def pose(rows: list[list[Column]], t: list[Column]) -> Column:
    """The 4 x 4 matrix, row by row."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*[x for r, d in zip(rows, t, strict=True) for x in [*r, d]], zero, zero, zero, one)


def to_world(rows: list[list[Column]], t: list[Column], p: list[Column]) -> list[Column]:
    return [r[0] * p[0] + r[1] * p[1] + r[2] * p[2] + d for r, d in zip(rows, t, strict=True)]


def back_project(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """Pinhole: camera coordinates of a pixel (null where the depth is not positive)."""
    z = F.when(depth > 0, depth)
    return [(u - cx) * z / fx, (v - cy) * z / fy, z]


def scale_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, sx: Column, sy: Column) -> tuple[Column, ...]:
    return fx * sx, fy * sy, cx * sx, cy * sy


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return (top - F.least(r, g, b)) / F.greatest(top, F.lit(1.0))


def segment_distance(a: Column, b: Column, offset: Column, start: Column, end: Column) -> Column:
    """Distance of (a across, b along) from the axis-aligned segment at `offset` from start to end."""
    along = F.greatest(start - b, b - end, F.lit(0.0))
    return F.sqrt((a - offset) * (a - offset) + along * along)


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    n2 = dx * dx + dy * dy
    t = F.when(n2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n2))).otherwise(F.lit(0.0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def inward_plane(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """Unit normal (nx, ny) of wall a-b that points to (cx, cy), and d = -n.a."""
    length = F.hypot(bx - ax, by - ay)
    nx, ny = -(by - ay) / length, (bx - ax) / length
    sign = F.when(nx * (cx - ax) + ny * (cy - ay) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    nx, ny = nx * sign, ny * sign
    return nx, ny, -(nx * ax + ny * ay)


def connector(ax: Column, ay: Column, anx: Column, any_: Column, bx: Column, by: Column, bnx: Column, bny: Column) -> Column:
    """The transform that takes midpoint b to midpoint a and normal b to minus normal a."""
    theta = wrap_angle(F.atan2(-any_, -anx) - F.atan2(bny, bnx))
    c, s = F.cos(theta), F.sin(theta)
    return se2(ax - (c * bx - s * by), ay - (s * bx + c * by), theta)
