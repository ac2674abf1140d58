"""Planar geometry, camera and rotation helpers on columns. Angles are clockwise from north, y points down."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .angles import col, wrap360, cosd, sind


def ray_rectangle(x, y, bearing_deg, width: float, height: float) -> Column:
    """Distance from an inside point to the wall of [0,w]x[0,h] along a bearing; NULL outside."""
    return wall_rectangle(x, y, *ray_direction(bearing_deg), width, height)


def ray_direction(bearing_deg) -> tuple[Column, Column]:
    b = col(bearing_deg)
    return sind(b), -cosd(b)


def wall_rectangle(x, y, dx, dy, width: float, height: float) -> Column:
    """ray_rectangle along a unit vector."""
    x, y, dx, dy = map(col, (x, y, dx, dy))
    eps = F.lit(1e-12)
    tx = F.when(dx > eps, (width - x) / dx).when(dx < -eps, -x / dx)
    ty = F.when(dy > eps, (height - y) / dy).when(dy < -eps, -y / dy)
    inside = (x >= 0) & (x <= width) & (y >= 0) & (y <= height)
    return F.when(inside, F.least(tx, ty))


def ray_circle(x, y, bearing_deg, cx: float, cy: float, radius: float) -> Column:
    """Distance from an inside point to a circle along a bearing; NULL outside."""
    return wall_circle(x, y, *ray_direction(bearing_deg), cx, cy, radius)


def wall_circle(x, y, dx, dy, cx: float, cy: float, radius: float) -> Column:
    """ray_circle along a unit vector."""
    px, py, dx, dy = col(x) - cx, col(y) - cy, col(dx), col(dy)
    dot = px * dx + py * dy
    disc = dot * dot - (px * px + py * py - radius * radius)
    inside = (px * px + py * py) <= radius * radius
    return F.when(inside, -dot + F.sqrt(F.greatest(disc, F.lit(0.0))))


def inside_circle(x, y, cx: float, cy: float, radius: float) -> Column:
    return F.hypot(col(x) - cx, col(y) - cy) <= radius


def pixel_to_cm(px, origin: float, cm_per_px: float) -> Column:
    return (col(px) - origin) * cm_per_px


def world_heading(pixel_heading_deg, sx: float, sy: float) -> Column:
    """Re-express a pixel heading when x and y have different scales."""
    h = col(pixel_heading_deg)
    return wrap360(F.degrees(F.atan2(sind(h) * sx, cosd(h) * sy)))


def bearing_to(x, y, tx, ty, heading_deg, on_target_deg: float | None = None) -> Column:
    """Clockwise bearing of a target from the head: 0 ahead, +90 right. On top of it NULL, or the given direction less the heading."""
    dx, dy = col(tx) - col(x), col(ty) - col(y)
    there = F.lit(on_target_deg).cast("double")
    away = F.when((dx != 0) | (dy != 0), F.degrees(F.atan2(dx, -dy))).when(dx.isNotNull() & dy.isNotNull(), there)
    return wrap360(away - col(heading_deg))


def ray_end(x, y, bearing_deg, dist) -> tuple[Column, Column]:
    return col(x) + col(dist) * sind(bearing_deg), col(y) - col(dist) * cosd(bearing_deg)


def project(x, y, h: list[list[float]]) -> tuple[Column, Column]:
    """Homogeneous 3x3 projection of a point; NULL on the horizon."""
    x, y = col(x), col(y)
    u = h[0][0] * x + h[0][1] * y + h[0][2]
    v = h[1][0] * x + h[1][1] * y + h[1][2]
    w = h[2][0] * x + h[2][1] * y + h[2][2]
    ok = F.abs(w) > 1e-12
    return F.when(ok, u / w), F.when(ok, v / w)


def rotate_offset(x, y, heading_deg, forward, right) -> tuple[Column, Column]:
    """Move a point by a head-fixed offset (eye relative to tracked center)."""
    h = col(heading_deg)
    return (col(x) + col(forward) * sind(h) + col(right) * cosd(h),
            col(y) - col(forward) * cosd(h) + col(right) * sind(h))


def arc_edges(x, y, heading_deg, left_deg, right_deg, cx: float, cy: float, radius: float) -> tuple[Column, Column]:
    """Egocentric bearings of both edges of a wall arc seen by an off-centre observer."""
    out = []
    for a in (left_deg, right_deg):
        ex, ey = F.lit(cx) + radius * sind(a), F.lit(cy) - radius * cosd(a)
        out.append(bearing_to(x, y, ex, ey, heading_deg))
    return out[0], out[1]


def quaternion_yaw(w, x, y, z) -> Column:
    """Yaw in degrees of a unit quaternion about the vertical (y) axis."""
    w, x, y, z = map(col, (w, x, y, z))
    return F.degrees(F.atan2(2.0 * (w * y + x * z), 1.0 - 2.0 * (y * y + x * x)))


def slerp(q0: list[Column], q1: list[Column], f: Column) -> list[Column]:
    """Spherical interpolation of two quaternions along the short way; linear when nearly parallel."""
    dot = q0[0] * q1[0] + q0[1] * q1[1] + q0[2] * q1[2] + q0[3] * q1[3]
    sign = F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    d = F.least(F.abs(dot), F.lit(1.0))
    ang = F.acos(d)
    near = d > 0.9995
    s = F.sin(ang)
    a = F.when(near, 1.0 - f).otherwise(F.sin((1.0 - f) * ang) / s)
    b = F.when(near, f).otherwise(F.sin(f * ang) / s) * sign
    mixed = [a * u + b * v for u, v in zip(q0, q1)]
    norm = F.sqrt(sum((m * m for m in mixed[1:]), mixed[0] * mixed[0]))
    return [m / norm for m in mixed]
