"""Outlier removal and 2.5D grid filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import elevation_cell
from .search import knn_join, nearest, radius_join


def neighbour_means(points: DataFrame, k: int, radius: float | None = None, *, squared: bool = False, by: Sequence[str] = (), pairs: DataFrame | None = None) -> DataFrame:
    """(pid, mean): mean distance to the k nearest others, all of them or those within the radius.

    A point without neighbours in the radius has the radius as its mean (its square if squared). pairs: a radius join of
    the same cloud with at least this radius, to be used again.
    """
    value = F.col("d2").cast("double") if squared else F.sqrt(F.col("d2").cast("double"))
    if radius is None:
        return knn_join(points, k).groupBy(F.col("qid").alias("pid")).agg(F.avg(value).alias("mean"))
    joined = pairs if pairs is not None else radius_join(points, points, radius, by)
    r = F.lit(radius).cast("float")
    means = nearest(joined.where((F.col("qid") != F.col("pid")) & (F.col("d2") <= r * r)), k, by).groupBy(*by, F.col("qid").alias("pid")).agg(F.avg(value).alias("mean"))
    lone = F.lit(radius * radius if squared else radius)
    return points.select(*by, "pid").join(means, [*by, "pid"], "left").select(*by, "pid", F.coalesce("mean", lone).alias("mean"))


def outlier_removal(points: DataFrame, k: int, alpha: float, radius: float | None = None, *, squared: bool = False, by: Sequence[str] = (), pairs: DataFrame | None = None) -> DataFrame:
    """Statistical outlier removal: keeps points whose mean distance is at most mu + alpha * sigma (population)."""
    means = neighbour_means(points, k, radius, squared=squared, by=by, pairs=pairs)
    limit = (F.avg("mean") + F.lit(alpha) * F.stddev_pop("mean")).alias("_limit")
    if by:
        kept = means.join(means.groupBy(*by).agg(limit), list(by)).where("mean <= _limit")
    else:
        kept = means.join(F.broadcast(means.agg(limit))).where("mean <= _limit")  # one row
    return points.join(kept.select(*by, "pid"), [*by, "pid"], "left_semi")


def radius_count_filter(points: DataFrame, radius: float, least: int, by: Sequence[str] = (), pairs: DataFrame | None = None) -> DataFrame:
    """Keeps points with at least ``least`` neighbours in the radius, themselves included. pairs: such a join, to be used again."""
    joined = pairs if pairs is not None else radius_join(points, points, radius, by)
    kept = joined.groupBy(*by, "qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return points.join(kept.select(*by, F.col("qid").alias("pid")), [*by, "pid"], "left_semi")


def agreement(points: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """How two filters of one cloud classify its points: counts of both, either, and the share that agrees."""
    flagged = points.select("pid").join(a.select("pid", F.lit(True).alias("a")), "pid", "left").join(b.select("pid", F.lit(True).alias("b")), "pid", "left")
    x, y = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return flagged.agg(F.count(F.lit(1)).alias("n"), F.sum(x.cast("long")).alias("kept_a"), F.sum(y.cast("long")).alias("kept_b"), F.sum((x == y).cast("long")).alias("same"))


def elevation_cells(points: DataFrame, size: float, by: Sequence[str] = (), low: tuple[float, float] | None = None) -> DataFrame:
    """Adds row and col of the 2.5D grid over x and y, from each frame's own corner unless ``low`` is given."""
    if low is not None:
        return points.withColumns({"col": elevation_cell(F.col("x"), F.lit(low[0]), size), "row": elevation_cell(F.col("y"), F.lit(low[1]), size)})
    corner = points.groupBy(*by).agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    joined = points.join(corner, list(by)) if by else points.join(F.broadcast(corner))  # without frames: one row
    return joined.withColumns({"col": elevation_cell(F.col("x"), F.col("_x"), size), "row": elevation_cell(F.col("y"), F.col("_y"), size)}).drop("_x", "_y")


def cell_stats(celled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lowest and highest z and the number of points of every occupied cell."""
    return celled.groupBy(*by, "row", "col").agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count(F.lit(1)).alias("n"))


def with_cell_stats(celled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Joins every point with its cell's statistics. A join of aggregates, not a window: a cell of very many points is
    reduced before the shuffle and its points are never gathered in one task."""
    return celled.join(cell_stats(celled, by), [*by, "row", "col"])


def density_filter(celled: DataFrame, least: int = 2, by: Sequence[str] = ()) -> DataFrame:
    return with_cell_stats(celled, by).where(F.col("n") >= least).drop("min_z", "max_z", "n")


def ground_split(celled: DataFrame, height: float, by: Sequence[str] = (), drop_singletons: bool = True) -> DataFrame:
    """Adds is_ground: z at most height above the cell's lowest point. Cells of a single point may be dropped."""
    rows = with_cell_stats(celled, by)
    if drop_singletons:
        rows = rows.where("n >= 2")
    return rows.withColumn("is_ground", F.col("z") <= F.col("min_z") + F.lit(height).cast("float")).drop("max_z", "n")


def ground_plane(split: DataFrame, default_z: float = -1.70) -> DataFrame:
    """The level plane through the mean ground height: (0, 0, 1, -mean); a default where there is no ground."""
    z = F.coalesce(F.avg(F.when(F.col("is_ground"), F.col("z").cast("double"))), F.lit(default_z))
    return split.agg(z.alias("_z")).select(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("c"), (-F.col("_z")).alias("d"))
