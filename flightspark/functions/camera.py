"""Pinhole camera expressions. Poses are R_wc (r00..r22) and t_wc (tx, ty, tz); cameras are fx, fy, cx, cy, k1, k2, p1, p2, k3."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightspark.functions import rotation as R


def default_focal(width, fov_deg: float = 80.0) -> Column:
    return (width / 2.0) / F.lit(math.tan(math.radians(fov_deg) / 2.0))


def distort(x: Column, y: Column, k1, k2, p1, p2, k3) -> tuple[Column, Column]:
    """Brown-Conrady displacement of normalised image coordinates."""
    r2 = x * x + y * y
    radial = F.lit(1.0) + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    return (x * radial + F.lit(2.0) * p1 * x * y + p2 * (r2 + F.lit(2.0) * x * x),
            y * radial + p1 * (r2 + F.lit(2.0) * y * y) + F.lit(2.0) * p2 * x * y)


def world_to_camera(p, r: list[Column], t) -> list[Column]:
    return R.apply(R.transpose(r), [a - b for a, b in zip(p, t)])


def camera_to_world(p, r: list[Column], t) -> list[Column]:
    return [a + b for a, b in zip(R.apply(r, p), t)]


def project(pc, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Pixel of a camera-frame point; null when it lies behind the camera."""
    z = F.when(pc[2] > 1e-4, pc[2])
    return fx * pc[0] / z + cx, fy * pc[1] / z + cy


def project_distorted(pc, fx, fy, cx, cy, k1, k2, p1, p2, k3) -> tuple[Column, Column]:
    z = F.when(pc[2] > 1e-4, pc[2])
    x, y = pc[0] / z, pc[1] / z
    straight = (F.abs(k1) <= 1e-7) & (F.abs(k2) <= 1e-7) & (F.abs(p1) <= 1e-7) & (F.abs(p2) <= 1e-7)
    xd, yd = distort(x, y, k1, k2, p1, p2, k3)
    return fx * F.when(straight, x).otherwise(xd) + cx, fy * F.when(straight, y).otherwise(yd) + cy


def unproject(u, v, depth, fx, fy, cx, cy) -> list[Column]:
    return [(u - cx) * depth / fx, (v - cy) * depth / fy, depth]


def in_image(u, v, width, height) -> Column:
    return (u >= 0) & (u < width) & (v >= 0) & (v < height)
