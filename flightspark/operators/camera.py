"""Camera tables: default intrinsics, rescaling, projection and unprojection of point tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightspark.functions import camera as C
from flightspark.functions import rotation as R
from flightspark.operators.scale import attach

# Grid on which a rectified frame is probed.
GRID_U, GRID_V = 96, 54


def camera_default(cameras: DataFrame, fov_deg: float = 80.0) -> DataFrame:
    """Intrinsics from image size (width, height) and field of view; a positive known_focal wins."""
    f = F.when(F.col("known_focal") > 0, F.col("known_focal")).otherwise(C.default_focal(F.col("width"), fov_deg))
    return cameras.withColumns({"fx": f, "fy": f, "cx": F.col("width") / 2.0, "cy": F.col("height") / 2.0})


def scale_intrinsics(cameras: DataFrame, width, height) -> DataFrame:
    """Intrinsics at another resolution."""
    sx, sy = width / F.col("width"), height / F.col("height")
    return cameras.withColumns({"fx": F.col("fx") * sx, "cx": F.col("cx") * sx, "fy": F.col("fy") * sy, "cy": F.col("cy") * sy,
                                "width": width, "height": height})


def rectified_coverage(cameras: DataFrame, by="flight_id") -> DataFrame:
    """Share of a probe grid of the rectified frame (target intrinsics nfx, nfy, ncx, ncy) that lands in the source."""
    d = cameras.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(GRID_U * GRID_V - 1))))
    u = (F.col("_g") % GRID_U) * ((F.col("width") - 1.0) / (GRID_U - 1))
    v = F.floor(F.col("_g") / GRID_U) * ((F.col("height") - 1.0) / (GRID_V - 1))
    d = d.withColumns({"_x": (u - F.col("ncx")) / F.col("nfx"), "_y": (v - F.col("ncy")) / F.col("nfy")})
    xd, yd = C.distort(F.col("_x"), F.col("_y"), *[F.col(k) for k in ("k1", "k2", "p1", "p2", "k3")])
    d = d.withColumns({"_us": F.col("fx") * xd + F.col("cx"), "_vs": F.col("fy") * yd + F.col("cy")})
    inside = F.col("_us").between(0, F.col("width") - 1) & F.col("_vs").between(0, F.col("height") - 1)
    return d.groupBy(by).agg(F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("coverage"))


def world_to_camera(points: DataFrame, poses: DataFrame, on=("flight_id", "frame_id")) -> DataFrame:
    """Adds xc, yc, zc: the points (x, y, z) in the frame of their pose."""
    d = attach(points, poses.select(*on, *R.R_NAMES, "tx", "ty", "tz"), list(on), "inner", compute_once=False)
    pc = C.world_to_camera([F.col(c) for c in "xyz"], R.r_cols(), [F.col(c) for c in ("tx", "ty", "tz")])
    return d.withColumns(dict(zip(("xc", "yc", "zc"), pc)))


def project(points: DataFrame, distortion: bool = True) -> DataFrame:
    """Adds u, v and valid to camera-frame points (xc, yc, zc) that carry their intrinsics and image size."""
    pc = [F.col(c) for c in ("xc", "yc", "zc")]
    k = [F.col(c) for c in ("fx", "fy", "cx", "cy")]
    if distortion:
        u, v = C.project_distorted(pc, *k, *[F.col(c) for c in ("k1", "k2", "p1", "p2", "k3")])
    else:
        u, v = C.project(pc, *k)
    d = points.withColumns({"u": u, "v": v})
    return d.withColumn("valid", F.col("u").isNotNull() & C.in_image(F.col("u"), F.col("v"), F.col("width"), F.col("height")))


def unproject(pixels: DataFrame) -> DataFrame:
    """Adds xc, yc, zc to pixels (u, v, depth) that carry their intrinsics."""
    pc = C.unproject(*[F.col(c) for c in ("u", "v", "depth", "fx", "fy", "cx", "cy")])
    return pixels.withColumns(dict(zip(("xc", "yc", "zc"), pc)))


def unproject_to_world(pixels: DataFrame, poses: DataFrame, on=("flight_id", "frame_id")) -> DataFrame:
    """Adds x, y, z in the world frame to pixels with depth."""
    d = attach(unproject(pixels), poses.select(*on, *R.R_NAMES, "tx", "ty", "tz"), list(on), "inner", compute_once=False)
    pw = C.camera_to_world([F.col(c) for c in ("xc", "yc", "zc")], R.r_cols(), [F.col(c) for c in ("tx", "ty", "tz")])
    return d.withColumns(dict(zip(("x", "y", "z"), pw)))


def ray_dirs(pixels: DataFrame) -> DataFrame:
    """Adds the unit viewing ray (dx, dy, dz) of each pixel in the camera frame."""
    x, y = (F.col("u") - F.col("cx")) / F.col("fx"), (F.col("v") - F.col("cy")) / F.col("fy")
    n = F.sqrt(x * x + y * y + F.lit(1.0))
    return pixels.withColumns({"dx": x / n, "dy": y / n, "dz": F.lit(1.0) / n})


def focal_error(cameras: DataFrame, fov_deg: float = 80.0) -> DataFrame:
    """Percent error of the default focal length against the calibrated one."""
    f = F.col("width") / 2.0 / F.lit(math.tan(math.radians(fov_deg) / 2.0))
    return cameras.withColumn("default_fx", f).withColumn("error_pct", F.abs(F.col("default_fx") - F.col("fx")) / F.col("fx") * 100.0)
