"""Rotation matrices (nine columns r00..r22) and quaternions (qw, qx, qy, qz) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q_NAMES = ["qw", "qx", "qy", "qz"]
R_NAMES = [f"r{i}{j}" for i in range(3) for j in range(3)]


def r_cols(prefix: str = "") -> list[Column]:
    return [F.col(prefix + n) for n in R_NAMES]


def matmul(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def transpose(a: list[Column]) -> list[Column]:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def apply(a: list[Column], v) -> list[Column]:
    return [a[3 * i] * v[0] + a[3 * i + 1] * v[1] + a[3 * i + 2] * v[2] for i in range(3)]


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def with_quat(df: DataFrame, r: list[Column] | None = None) -> DataFrame:
    """Adds the unit quaternion of a rotation, taken from the largest of the trace and the three diagonal entries.

    Built in steps so that each intermediate column is computed once instead of being copied into every expression.
    """
    r = r or r_cols()
    d = df.withColumns({f"_m{i}": c for i, c in enumerate(r)})
    m = [F.col(f"_m{i}") for i in range(9)]
    case = F.when(m[0] + m[4] + m[8] > 0, 0).when((m[0] > m[4]) & (m[0] > m[8]), 1).when(m[4] > m[8], 2).otherwise(3)
    d = d.withColumn("_case", case)
    lead = [m[0] + m[4] + m[8], m[0] - m[4] - m[8], m[4] - m[0] - m[8], m[8] - m[0] - m[4]]

    def pick(options):
        out = options[3]
        for i in (2, 1, 0):
            out = F.when(F.col("_case") == i, options[i]).otherwise(out)
        return out

    d = d.withColumn("_s", F.lit(2.0) * F.sqrt(pick(lead) + 1.0))
    s = F.col("_s")
    quarter = s / 4
    wx, wy, wz = (m[7] - m[5]) / s, (m[2] - m[6]) / s, (m[3] - m[1]) / s
    xy, xz, yz = (m[1] + m[3]) / s, (m[2] + m[6]) / s, (m[5] + m[7]) / s
    d = d.withColumns(dict(zip(Q_NAMES, (pick([quarter, wx, wy, wz]), pick([wx, quarter, xy, xz]),
                                         pick([wy, xy, quarter, yz]), pick([wz, xz, yz, quarter])))))
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in Q_NAMES[1:]), F.col("qw") * F.col("qw")))
    d = d.withColumn("_n", F.when(n > 1e-12, n).otherwise(1.0))
    return d.withColumns({c: F.col(c) / F.col("_n") for c in Q_NAMES}).drop("_case", "_s", "_n", *[f"_m{i}" for i in range(9)])


def quat_to_rot(q: list[Column]) -> list[Column]:
    w, x, y, z = q
    two = F.lit(2.0)
    return [F.lit(1.0) - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w),
            two * (x * y + z * w), F.lit(1.0) - two * (x * x + z * z), two * (y * z - x * w),
            two * (x * z - y * w), two * (y * z + x * w), F.lit(1.0) - two * (x * x + y * y)]


def with_slerp(df: DataFrame, a: str, b: str, alpha: str) -> DataFrame:
    """Adds qw..qz at `alpha` between the quaternions of structs `a` and `b`, on the shorter arc; nearly equal rotations
    are interpolated linearly."""
    qa, qb = ([F.col(f"{s}.{n}") for n in Q_NAMES] for s in (a, b))
    raw = sum((p * q for p, q in zip(qa[1:], qb[1:])), qa[0] * qb[0])
    d = df.withColumn("_dot", raw).withColumn("_sg", F.when(F.col("_dot") < 0, -1.0).otherwise(1.0))
    d = d.withColumn("_dot", F.abs("_dot")).withColumn("_th", F.acos(F.least(F.lit(1.0), F.col("_dot"))))
    d = d.withColumn("_w1", F.when(F.col("_dot") > 0.9995, F.col(alpha)).otherwise(F.sin(F.col("_th") * F.col(alpha)) / F.sin("_th")))
    d = d.withColumn("_w0", F.when(F.col("_dot") > 0.9995, F.lit(1.0) - F.col(alpha)).otherwise(
        F.cos(F.col("_th") * F.col(alpha)) - F.col("_dot") * F.col("_w1")))
    d = d.withColumns({n: F.col("_w0") * p + F.col("_w1") * F.col("_sg") * q for n, p, q in zip(Q_NAMES, qa, qb)})
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in Q_NAMES[1:]), F.col("qw") * F.col("qw")))
    d = d.withColumn("_n", F.when(F.col("_dot") > 0.9995, n).otherwise(1.0))
    return d.withColumns({c: F.col(c) / F.col("_n") for c in Q_NAMES}).drop("_dot", "_sg", "_th", "_w0", "_w1", "_n")


def euler(yaw, pitch, roll) -> list[Column]:
    """Rotation about z by yaw, then y by pitch, then x by roll (degrees)."""
    cy, sy = F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    cp, sp = F.cos(F.radians(pitch)), F.sin(F.radians(pitch))
    cr, sr = F.cos(F.radians(roll)), F.sin(F.radians(roll))
    return [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr,
            sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr,
            -sp, cp * sr, cp * cr]


def body_to_camera_rotation(yaw, pitch, roll) -> list[Column]:
    """World axes of a forward-looking camera: right is body y, down is body -z, forward is body x.

    With body z up these axes are left-handed; downstream numbers depend on it, so it is kept.
    """
    body = euler(yaw, pitch, roll)
    return [c for i in range(3) for c in (body[3 * i + 1], -body[3 * i + 2], body[3 * i])]


def with_rotation_vector(df: DataFrame) -> DataFrame:
    """Adds wx, wy, wz: axis times angle of the rotation r00..r22."""
    d = with_quat(df)
    d = d.withColumn("_s", F.sqrt(F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + F.col("qz") * F.col("qz")))
    d = d.withColumn("_f", F.when(F.col("_s") < 1e-12, 2.0).otherwise(F.lit(2.0) * F.atan2("_s", F.abs("qw")) / F.col("_s"))
                     * F.when(F.col("qw") < 0, -1.0).otherwise(1.0))
    return d.withColumns({f"w{a}": F.col(f"q{a}") * F.col("_f") for a in "xyz"}).drop("_s", "_f", *Q_NAMES)
