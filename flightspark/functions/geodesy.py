"""WGS84 and local East-North-Up conversions as column expressions (angles in degrees, lengths in metres)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_B = 6356752.314245
E2 = (WGS84_A**2 - WGS84_B**2) / WGS84_A**2
EP2 = (WGS84_A**2 - WGS84_B**2) / WGS84_B**2

Triple = tuple[Column, Column, Column]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def geodetic_to_ecef(lat, lon, alt) -> Triple:
    phi, lam, h = F.radians(_col(lat)), F.radians(_col(lon)), _col(alt)
    n = F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(E2) * F.sin(phi) * F.sin(phi))
    return ((n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * F.lit(1.0 - E2) + h) * F.sin(phi))


def _axes(lat, lon) -> tuple[Triple, Triple, Triple]:
    """East, north and up unit vectors of the tangent plane in earth-fixed coordinates."""
    phi, lam = F.radians(_col(lat)), F.radians(_col(lon))
    sp, cp, sl, cl = F.sin(phi), F.cos(phi), F.sin(lam), F.cos(lam)
    return (-sl, cl, F.lit(0.0)), (-sp * cl, -sp * sl, cp), (cp * cl, cp * sl, sp)


def ecef_to_enu(x, y, z, ref_lat, ref_lon, ref_alt) -> Triple:
    rx, ry, rz = geodetic_to_ecef(ref_lat, ref_lon, ref_alt)
    d = (_col(x) - rx, _col(y) - ry, _col(z) - rz)
    return tuple(a[0] * d[0] + a[1] * d[1] + a[2] * d[2] for a in _axes(ref_lat, ref_lon))


def enu_to_ecef(e, n, u, ref_lat, ref_lon, ref_alt) -> Triple:
    ref = geodetic_to_ecef(ref_lat, ref_lon, ref_alt)
    east, north, up = _axes(ref_lat, ref_lon)
    return tuple(ref[i] + east[i] * _col(e) + north[i] * _col(n) + up[i] * _col(u) for i in range(3))


def ecef_to_geodetic(x, y, z) -> Triple:
    x, y, z = _col(x), _col(y), _col(z)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * F.lit(WGS84_A), p * F.lit(WGS84_B))
    lat = F.atan2(z + F.lit(EP2 * WGS84_B) * F.pow(F.sin(theta), 3), p - F.lit(E2 * WGS84_A) * F.pow(F.cos(theta), 3))
    n = F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(E2) * F.sin(lat) * F.sin(lat))
    pole = p < 1e-6
    return (F.when(pole, F.when(z > 0, 90.0).otherwise(-90.0)).otherwise(F.degrees(lat)),
            F.when(pole, 0.0).otherwise(F.degrees(F.atan2(y, x))),
            F.when(pole, F.abs(z) - F.lit(WGS84_B)).otherwise(p / F.cos(lat) - n))


def enu_to_geodetic(e, n, u, ref_lat, ref_lon, ref_alt) -> Triple:
    return ecef_to_geodetic(*enu_to_ecef(e, n, u, ref_lat, ref_lon, ref_alt))
