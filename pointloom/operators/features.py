"""Local covariance, normals and curvature, entirely in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import with_smallest_eigen
from .search import knn_join, radius_join
from .stats import XYZ

_TERMS = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))


def covariance(neighbours: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(pid, n, centroid, six covariance terms) of each query's neighbours; population covariance."""
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(F.col(c).cast("double")).alias(f"m{c}") for c in XYZ)]
    aggs += [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(a + b) for a, b in _TERMS]
    return neighbours.groupBy(*by, F.col("qid").alias("pid")).agg(*aggs)


def normals(points: DataFrame, cov: DataFrame, viewpoint: tuple[float, float, float] = (0.0, 0.0, 0.0), least: int = 3, by: Sequence[str] = (), flip: bool = True, fallback: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(pid, nx, ny, nz, curvature, valid): unit normals that face the viewpoint, or as they come if flip is false.

    Fewer than ``least`` neighbours, or neighbours without a plane, give ``fallback`` and valid = false.
    """
    eigen = with_smallest_eigen(cov.select(*by, "pid", "n", *(a + b for a, b in _TERMS))).withColumn("t", F.col("xx") + F.col("yy") + F.col("zz"))
    rows = points.select(*by, "pid", *XYZ).join(eigen.select(*by, "pid", "n", F.col("eigenvalue").alias("l"), *(F.col(f"e{c}").alias(f"_{c}") for c in XYZ), "t"), [*by, "pid"], "left")
    toward = sum(((F.lit(v) - F.col(c).cast("double")) * F.col(f"_{c}") for v, c in zip(viewpoint, XYZ, strict=True)), F.lit(0.0))
    valid = F.coalesce((F.col("n") >= least) & F.col("_x").isNotNull(), F.lit(False))
    turned = [F.when(valid, F.when((toward < 0) & flip, -F.col(f"_{c}")).otherwise(F.col(f"_{c}"))).otherwise(float(v)).alias(f"n{c}") for c, v in zip(XYZ, fallback, strict=True)]
    return rows.select(*by, "pid", *turned, F.when(valid & (F.col("t") > 0), F.col("l") / F.col("t")).otherwise(0.0).alias("curvature"), valid.alias("valid"))


def normals_radius(points: DataFrame, radius: float, viewpoint: tuple[float, float, float] = (0.0, 0.0, 0.0), by: Sequence[str] = (), pairs: DataFrame | None = None, **options) -> DataFrame:
    """Normals from all neighbours in the radius (the point itself too); options are those of ``normals``."""
    return normals(points, covariance(pairs if pairs is not None else radius_join(points, points, radius, by), by), viewpoint, by=by, **options)


def normals_knn(points: DataFrame, k: int, viewpoint: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Normals from the point and its k nearest others."""
    own = points.select(F.col("pid").alias("qid"), *XYZ)
    return normals(points, covariance(knn_join(points, k).select("qid", *XYZ).unionByName(own)), viewpoint)
