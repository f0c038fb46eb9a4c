"""Distances, planes, eigenvectors and colours as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the palette: first hue, step of the golden ratio, saturation, value.
HUE_START, HUE_STEP, SATURATION, VALUE = 0.35, 0.618034, 0.85, 0.95


def distance_sq(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Squared distance in the precision of the inputs, summed left to right."""
    dx, dy, dz = (p - q for p, q in zip(a, b, strict=True))
    return dx * dx + dy * dy + dz * dz


def plane_distance(p: tuple[Column, Column, Column], plane: tuple[Column, Column, Column, Column]) -> Column:
    """Signed distance a*x + b*y + c*z + d, in double precision."""
    x, y, z = (v.cast("double") for v in p)
    a, b, c, d = plane
    return a * x + b * y + c * z + d


def plane_from_points(p: list[tuple[Column, Column, Column]], least_norm: float = 1e-6) -> tuple[Column, Column, Column, Column]:
    """Unit normal and offset of the plane through three points; null where they are collinear."""
    (x0, y0, z0), (x1, y1, z1), (x2, y2, z2) = [tuple(v.cast("double") for v in q) for q in p]
    ux, uy, uz, vx, vy, vz = x1 - x0, y1 - y0, z1 - z0, x2 - x0, y2 - y0, z2 - z0
    nx, ny, nz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    norm = F.sqrt(nx * nx + ny * ny + nz * nz)
    ok = norm >= least_norm
    a, b, c = (F.when(ok, v / norm) for v in (nx, ny, nz))
    return a, b, c, -(a * x0 + b * y0 + c * z0)


def with_smallest_eigen(rows: DataFrame) -> DataFrame:
    """Adds eigenvalue and ex, ey, ez for the symmetric matrix in the columns xx, xy, xz, yy, yz, zz.

    The least root of the characteristic polynomial in its trigonometric form; the unit vector is the longest cross
    product of two rows of A - l*I, null where all of them vanish. Each step is a projection of its own, so nothing is
    computed twice.
    """
    c = F.col
    xy, xz, yz = c("xy"), c("xz"), c("yz")
    rows = rows.withColumn("_m", (c("xx") + c("yy") + c("zz")) / 3)
    rows = rows.withColumns({"_a": c("xx") - c("_m"), "_b": c("yy") - c("_m"), "_c": c("zz") - c("_m")})
    a, b, d = c("_a"), c("_b"), c("_c")
    rows = rows.withColumns({"_p": (a * a + b * b + d * d + 2 * (xy * xy + xz * xz + yz * yz)) / 6, "_q": (a * (b * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - b * xz)) / 2})
    ratio = F.when(c("_p") > 0, F.greatest(F.least(c("_q") / (c("_p") * F.sqrt("_p")), F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(1.0))
    rows = rows.withColumn("eigenvalue", c("_m") + 2 * F.sqrt("_p") * F.cos(F.acos(ratio) / 3 + F.lit(2 * math.pi / 3)))
    rows = rows.withColumns({"_x": c("xx") - c("eigenvalue"), "_y": c("yy") - c("eigenvalue"), "_z": c("zz") - c("eigenvalue")})
    r = [(c("_x"), xy, xz), (xy, c("_y"), yz), (xz, yz, c("_z"))]
    pairs = [(0, 1), (0, 2), (1, 2)]
    rows = rows.withColumns({f"_{n}{k}": v for k, (i, j) in enumerate(pairs) for n, v in zip("uvw", (r[i][1] * r[j][2] - r[i][2] * r[j][1], r[i][2] * r[j][0] - r[i][0] * r[j][2], r[i][0] * r[j][1] - r[i][1] * r[j][0]), strict=True)})
    rows = rows.withColumns({f"_s{k}": c(f"_u{k}") * c(f"_u{k}") + c(f"_v{k}") * c(f"_v{k}") + c(f"_w{k}") * c(f"_w{k}") for k in range(3)})
    rows = rows.withColumn("_best", F.greatest("_s0", "_s1", "_s2"))
    pick = {f"e{n}": F.when(c("_best") > 0, F.when(c("_s0") == c("_best"), c(f"_{o}0")).when(c("_s1") == c("_best"), c(f"_{o}1")).otherwise(c(f"_{o}2")) / F.sqrt("_best")) for n, o in zip("xyz", "uvw", strict=True)}
    rows = rows.withColumns(pick)
    return rows.drop(*(n for n in rows.columns if n.startswith("_")))


def hsv_to_rgb(h: Column, s: float, v: float) -> tuple[Column, Column, Column]:
    """Channels 0..255, truncated; h in [0, 1)."""
    sector = F.floor(h * 6)
    f = h * 6 - sector
    p, q, t = F.lit(v * (1 - s)), F.lit(v) * (1 - F.lit(s) * f), F.lit(v) * (1 - F.lit(s) * (1 - f))
    full = F.lit(v)
    wheel = [(full, t, p), (q, full, p), (p, full, t), (p, q, full), (t, p, full), (full, p, q)]
    k = sector % 6

    def channel(i: int) -> Column:
        c = F.when(k == 0, wheel[0][i])
        for j in range(1, 6):
            c = c.when(k == j, wheel[j][i])
        return F.floor(c * 255).cast("int")

    return channel(0), channel(1), channel(2)


def cluster_color(ordinal: Column) -> tuple[Column, Column, Column]:
    """Colour of the cluster with this ordinal (from 0): hues a golden ratio apart."""
    turn = F.lit(HUE_START) + (ordinal + 1) * F.lit(HUE_STEP)
    return hsv_to_rgb(turn - F.floor(turn), SATURATION, VALUE)
