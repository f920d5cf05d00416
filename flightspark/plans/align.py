"""Queries over metric alignment. Targets are built from the telemetry path by a known map, so fits have known answers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from flightspark.functions import rotation as R
from flightspark.operators import align as al
from flightspark.plans import views as v
from flightspark.plans.registry import cte, register

_C30, _S30 = math.cos(math.radians(30)), math.sin(math.radians(30))


def _pairs(spark, sf_dir, noise: bool = False):
    """dst = 1.7 * Rz(30) * src + (5, -3, 2); with `noise`, disturbed on every axis and the height scaled differently."""
    p = v.poses(spark, sf_dir)
    far = "CASE WHEN frame_id % 29 = 0 THEN 400D ELSE 0D END" if noise else "0D"
    ripple, zs = ("(frame_id * 7 % 13 - 6) * 0.3D", "1.2D") if noise else ("0D", "1.7D")
    return p.selectExpr("flight_id", "frame_id", "tx AS sx", "ty AS sy", "tz AS sz", f"1.7D * ({_C30!r}D * tx - {_S30!r}D * ty) + 5 + {ripple} + {far} AS dx",
                        f"1.7D * ({_S30!r}D * tx + {_C30!r}D * ty) - 3 - {ripple} AS dy", f"{zs} * tz + 2 + {ripple} AS dz", "0.5D + unc AS sig", "0.3D + unc / 4 AS sig_z")


cte("a_noise", f"""
SELECT flight_id, frame_id, tx AS sx, ty AS sy, tz AS sz, 1.7 * ({_C30!r} * tx - {_S30!r} * ty) + 5 + rp + CASE WHEN frame_id % 29 = 0 THEN 400 ELSE 0 END AS dx,
  1.7 * ({_S30!r} * tx + {_C30!r} * ty) - 3 - rp AS dy, 1.2 * tz + 2 + rp AS dz, 0.5 + unc AS sig, 0.3 + unc / 4 AS sig_z FROM (SELECT *, (frame_id * 7 % 13 - 6) * 0.3 AS rp FROM v_poses)""")
_KNOWN = f"SELECT flight_id, count(*) AS n, 1.7 AS scale, {_C30!r} AS r00, {_S30!r} AS r10, 1 AS r22, 5 AS t0, -3 AS t1, 2 AS t2 FROM v_poses GROUP BY 1"


@register("umeyama", "flight_id:i n:i scale:6 r00:6 r10:6 r22:6 t0:4 t1:4 t2:4", _KNOWN)
def _umeyama(spark, sf_dir):
    return al.umeyama(_pairs(spark, sf_dir), F.lit(1.0) / F.col("sig"))


@register("align_gps_irls", "flight_id:i n:i scale:6 r00:6 r10:6 r22:6 t0:4 t1:4 t2:4 rmse_m:4 disagreement:4", f"SELECT *, 0 AS rmse_m, 0 AS disagreement FROM ({_KNOWN})")
def _irls(spark, sf_dir):
    return al.align_gps_irls(_pairs(spark, sf_dir))


def _fixed_fit(spark, sf_dir):
    r = dict(zip(R.R_NAMES, [_C30, -_S30, 0.0, _S30, _C30, 0.0, 0.0, 0.0, 1.0]))
    f = v.poses(spark, sf_dir).select("flight_id").distinct()
    return f.withColumns({"scale": F.lit(1.7), **{k: F.lit(x) for k, x in r.items()}, "t0": F.lit(5.0), "t1": F.lit(-3.0), "t2": F.lit(2.0)})


cte("a_cen", f"""
SELECT flight_id, sig, sig_z, w, {_C30!r}*(sx-msx) - {_S30!r}*(sy-msy) AS a0, {_S30!r}*(sx-msx) + {_C30!r}*(sy-msy) AS a1, sz-msz AS a2, dx-mdx AS b0, dy-mdy AS b1, dz-mdz AS b2
FROM (SELECT *, 1/sig AS w FROM a_noise) JOIN (SELECT flight_id, sum(sx/sig)/sum(1/sig) AS msx, sum(sy/sig)/sum(1/sig) AS msy, sum(sz/sig)/sum(1/sig) AS msz, sum(dx/sig)/sum(1/sig) AS mdx,
  sum(dy/sig)/sum(1/sig) AS mdy, sum(dz/sig)/sum(1/sig) AS mdz FROM a_noise GROUP BY 1) USING (flight_id)""")


@register("scale_anisotropic", "flight_id:i aniso:6", """
SELECT flight_id, sum((a0*b0 + a1*b1)/(sig*sig)*w*sig + a2*b2/(sig_z*sig_z)*w*sig) / sum((a0*a0 + a1*a1)/(sig*sig)*w*sig + a2*a2/(sig_z*sig_z)*w*sig) AS aniso FROM a_cen GROUP BY 1""")
def _aniso(spark, sf_dir):
    return al.scale_anisotropic(_pairs(spark, sf_dir, True).withColumn("w", 1 / F.col("sig")), _fixed_fit(spark, sf_dir))


@register("scale_observability", "flight_id:i scale_h:6 scale_z:6 extent_h:3 extent_z:3 disagreement:6 flagged:b", """
SELECT *, abs(scale_h - scale_z) / greatest(scale_h, scale_z) AS disagreement, abs(scale_h - scale_z) / greatest(scale_h, scale_z) > 0.15 AS flagged FROM (
SELECT flight_id, sum(a0*b0 + a1*b1) / sum(a0*a0 + a1*a1) AS scale_h, sum(a2*b2) / sum(a2*a2) AS scale_z, sqrt((max(b0)-min(b0))**2 + (max(b1)-min(b1))**2) AS extent_h, max(b2) - min(b2) AS extent_z FROM a_cen GROUP BY 1)""")
def _observability(spark, sf_dir):
    return al.scale_observability(_pairs(spark, sf_dir, True).withColumn("w", 1 / F.col("sig")), _fixed_fit(spark, sf_dir))


@register("apply_similarity", "flight_id:i frame_id:i tx:3 ty:3 tz:3 r00:5 r10:5 r11:5 r22:5", f"""
SELECT flight_id, frame_id, 1.7*({_C30!r}*tx - {_S30!r}*ty) + 5 AS tx, 1.7*({_S30!r}*tx + {_C30!r}*ty) - 3 AS ty, 1.7*tz + 2 AS tz, {_C30!r}*c - {_S30!r}*s AS r00, {_S30!r}*c + {_C30!r}*s AS r10,
  -{_S30!r}*s + {_C30!r}*c AS r11, 1 AS r22 FROM v_poses""")
def _apply(spark, sf_dir):
    return al.apply_similarity(v.poses(spark, sf_dir), _fixed_fit(spark, sf_dir))


# Largest eigenvalue of a symmetric 3 x 3 matrix in closed form, and the squared components of its vector.
cte("x_cov", """
SELECT flight_id, avg(tx) AS cx, avg(ty) AS cy, avg(tz) AS cz, var_samp(tx) AS a, var_samp(ty) AS b, var_samp(tz) AS c, covar_samp(tx, ty) AS d, covar_samp(tx, tz) AS e, covar_samp(ty, tz) AS f FROM v_poses GROUP BY 1""")
cte("x_eig", """
SELECT *, q + 2*p*cos(ph) AS l1, q + 2*p*cos(ph + 2*pi()/3) AS l3, 3*q - (q + 2*p*cos(ph)) - (q + 2*p*cos(ph + 2*pi()/3)) AS l2 FROM (
SELECT *, acos(least(1, greatest(-1, ((a-q)*((b-q)*(c-q) - f*f) - d*(d*(c-q) - e*f) + e*(d*f - (b-q)*e)) / (2*p*p*p)))) / 3 AS ph FROM (
SELECT *, (a+b+c)/3 AS q, sqrt((((a-(a+b+c)/3)**2 + (b-(a+b+c)/3)**2 + (c-(a+b+c)/3)**2) + 2*(d*d + e*e + f*f)) / 6) AS p FROM x_cov))""")


@register("flight_axis", "flight_id:i cx:3 cy:3 cz:3 ax2:5 ay2:5 az2:5 straightness:6", """
SELECT flight_id, cx, cy, cz, l1 / (a+b+c) AS straightness, ((l1-b)*(l1-c) - f*f) / ((l1-l2)*(l1-l3)) AS ax2, ((l1-a)*(l1-c) - e*e) / ((l1-l2)*(l1-l3)) AS ay2, ((l1-a)*(l1-b) - d*d) / ((l1-l2)*(l1-l3)) AS az2 FROM x_eig""")
def _axis(spark, sf_dir):
    d = al.flight_axis(v.poses(spark, sf_dir))
    return d.withColumns({f"a{c}2": F.col("a" + c) * F.col("a" + c) for c in "xyz"})


def _refit_sql() -> str:
    """Four passes of the robust shift, one sub-select each."""
    parts = ["w0 AS (SELECT *, 1 / greatest(0.5, sig) AS w, 1 / greatest(0.05, sig_z) AS wz FROM a_noise)"]
    for k in range(4):
        parts.append(f"s{k} AS (SELECT flight_id, sum(w*(dx-sx))/sum(w) AS d0, sum(w*(dy-sy))/sum(w) AS d1, sum(wz*(dz-sz))/sum(wz) AS d2 FROM w{k} GROUP BY 1)")
        parts.append(f"r{k} AS (SELECT w{k}.*, d0, d1, d2, sqrt((sx+d0-dx)**2 + (sy+d1-dy)**2 + (sz+d2-dz)**2) AS rs FROM w{k} JOIN s{k} USING (flight_id))")
        if k < 3:
            parts.append(f"m{k} AS (SELECT flight_id, quantile_cont(rs, 0.5) AS med FROM r{k} GROUP BY 1)")
            parts.append(f"l{k} AS (SELECT r.flight_id, greatest(2, any_value(med) + 2*greatest(0.5, 1.4826*quantile_cont(abs(rs - med), 0.5))) AS lim FROM r{k} r JOIN m{k} USING (flight_id) GROUP BY 1)")
            parts.append(f"w{k + 1} AS (SELECT r.* EXCLUDE (d0, d1, d2, rs, w), CASE WHEN rs <= lim THEN w ELSE w*lim/greatest(1e-6, rs) END AS w FROM r{k} r JOIN l{k} USING (flight_id))")
    return f"WITH {', '.join(parts)} SELECT flight_id, any_value(d0) AS d0, any_value(d1) AS d1, any_value(d2) AS d2, sqrt(avg(rs*rs)) AS rmse_m, quantile_cont(rs, 0.5) AS median_m FROM r3 GROUP BY 1"


@register("refit_translation", "flight_id:i d0:4 d1:4 d2:4 rmse_m:4 median_m:4", _refit_sql())
def _refit(spark, sf_dir):
    return al.refit_translation(_pairs(spark, sf_dir, True))


@register("resolve_roll", "flight_id:i roll_deg:5 straightness:6 from_plane:b drop:4 r11:5 r21:5", """
SELECT flight_id, 20 AS roll_deg, 1 AS straightness, false AS from_plane, 50 - quantile_cont(pz, 0.5) AS drop, cos(radians(20)) AS r11, sin(radians(20)) AS r21
FROM (SELECT flight_id, z AS pz FROM v_surfels) GROUP BY 1""")
def _roll(spark, sf_dir):
    """A straight path along x whose cameras and scene were rolled by -20 degrees; levelling it turns them back."""
    c, s = math.cos(math.radians(-20)), math.sin(math.radians(-20))
    poses = v.cams(spark, sf_dir).select("flight_id", (F.col("frame_id") * 3.0 + 100).alias("tx"), F.lit(-50 * s).alias("ty"), F.lit(50 * c).alias("tz"),
                                         F.lit(0.0).alias("r02"), F.lit(s).alias("r12"), F.lit(-c).alias("r22"))
    pts = v.surfels(spark, sf_dir).select("flight_id", "x", (F.lit(-s) * F.col("z")).alias("y"), (F.lit(c) * F.col("z")).alias("z"))
    return al.resolve_roll(poses, pts)


@register("icp_register", "flight_id:i r00:2 t0:2 t1:2 rejected:b", """
SELECT flight_id, 1 AS r00, -0.02 AS t0, 0.01 AS t1, false AS rejected FROM v_surfels GROUP BY 1 HAVING count(*) >= 50""")
def _icp(spark, sf_dir):
    """The same surfels moved by two centimetres; the correction moves them back."""
    s = v.surfels(spark, sf_dir)
    moved = s.selectExpr("flight_id", "element_id AS s_id", "x + 0.02D AS x", "y - 0.01D AS y", "z AS z")
    return al.icp_register(moved, s)
