"""Voxel grids, bounding boxes and global kernels: one pass, partial aggregation, no collected groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance_sq, voxel

XYZ = ("x", "y", "z")


def xyz(prefix: str = "") -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in XYZ)


def voxel_grid(points: DataFrame, leaf: float, by: Sequence[str] = ()) -> DataFrame:
    """Centroid and size of every occupied voxel; the mean is in double precision."""
    keyed = points.select(*by, *XYZ, *(voxel(F.col(c), leaf).alias(f"v{c}") for c in XYZ))
    return keyed.groupBy(*by, "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in XYZ))


def downsample(points: DataFrame, leaf: float, by: Sequence[str] = ()) -> DataFrame:
    """One point a voxel: its centroid in single precision, and the least pid in it as its id."""
    keyed = points.select(*by, "pid", *XYZ, *(voxel(F.col(c), leaf).alias(f"v{c}") for c in XYZ))
    return keyed.groupBy(*by, "vx", "vy", "vz").agg(F.min("pid").alias("pid"), *(F.avg(c).cast("float").alias(c) for c in XYZ)).select(*by, "pid", *XYZ)


def adaptive_leaf(points: DataFrame, target: int) -> float:
    """Leaf for about ``target`` voxels: the cube root of volume over target, within [0.001, largest extent / 10]."""
    box = bounding_box(points).first()
    extent = [float(box[f"max_{c}"]) - float(box[f"min_{c}"]) for c in XYZ]
    leaf = (extent[0] * extent[1] * extent[2] / target) ** (1 / 3)
    return max(0.001, min(leaf, max(extent) / 10))


def bounding_box(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max)))]
    return points.groupBy(*by).agg(*aggs) if by else points.agg(*aggs)


def l2_checksum(points: DataFrame, query: tuple[float, float, float]) -> DataFrame:
    """Sum of the whole parts of all squared distances to a point."""
    q = tuple(F.lit(v).cast("float") for v in query)
    return points.agg(F.sum(F.floor(distance_sq(xyz(), q))).cast("long").alias("checksum"))


def reduction_stats(points: DataFrame) -> DataFrame:
    """Mean and variance of x + y + z (E[v^2] - E[v]^2, both whole), and the two mixed into one number."""
    v = (F.col("x") + F.col("y") + F.col("z")).cast("long")
    s = points.agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    mean = F.floor(F.col("s") / F.col("n"))
    var = F.floor(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")))
    return s.select(F.col("n"), mean.cast("long").alias("mean"), var.cast("long").alias("variance"), F.shiftleft(mean.cast("long"), 32).bitwiseXOR(var.cast("long")).alias("checksum"))


def masked_filter(points: DataFrame, most: float) -> DataFrame:
    return points.where(F.col("x") + F.col("y") + F.col("z") <= F.lit(most).cast("float")).agg(F.count(F.lit(1)).alias("n"))


def triples(points: DataFrame, block: int = 4096) -> DataFrame:
    """Cross products of consecutive points (pid, pid + 1, pid + 2), for dense pids.

    Blocks of consecutive pids overlap by two points, so each is a window of its own and none grows with the input.
    """
    b = F.expr(f"pid div {block}")
    both = F.when((F.pmod("pid", F.lit(block)) < 2) & (F.col("pid") >= block), F.array(b, b - 1)).otherwise(F.array(b))
    w = Window.partitionBy("block").orderBy("pid")
    rows = points.select("*", F.explode(both).alias("block"))
    for i in (1, 2):
        rows = rows.withColumns({f"{c}{i}": F.lead(c, i).over(w) for c in XYZ})
    rows = rows.where(F.col("x2").isNotNull() & (F.expr(f"pid div {block}") == F.col("block")))
    u, v = [tuple(F.col(f"{c}{i}") - F.col(c) for c in XYZ) for i in (1, 2)]
    cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return rows.select("pid", *(c.alias(f"c{n}") for c, n in zip(cross, XYZ, strict=True)))


def triple_cross(points: DataFrame) -> DataFrame:
    return triples(points).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.floor(F.abs(f"c{c}"))).cast("long").alias(f"sum_{c}") for c in XYZ))


def global_rank(rows: DataFrame, order: Sequence[str], bucket: Column, name: str = "rk") -> DataFrame:
    """Dense ranks from 0 in the given order. bucket: a value that never falls along that order.

    Ranks are taken inside buckets and shifted by the totals of the buckets before, so no task sees all rows.
    The totals (a row a bucket) are what a single task sums.
    """
    rows = rows.withColumn("_b", bucket)
    totals = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = totals.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return rows.withColumn("_in", inside).join(ahead, "_b").withColumn(name, (F.col("_in") + F.col("_start")).cast("long")).drop("_b", "_in", "_start")


def ranked(rows: DataFrame, by: str, name: str = "rk", buckets: int = 1024) -> DataFrame:
    """Adds the dense rank by a whole-numbered column, bucketed by equal ranges of it."""
    box = rows.agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"))
    joined = rows.join(F.broadcast(box))  # one row
    step = F.greatest(F.expr(f"(_hi - _lo) div {buckets} + 1"), F.lit(1))
    return global_rank(joined.withColumn("_step", step), [by], F.expr(f"({by} - _lo) div _step"), name).drop("_lo", "_hi", "_step")


def voxel_ids(points: DataFrame, leaf: float) -> DataFrame:
    """Occupied voxels with dense ids from 0 in the order of (vx, vy, vz)."""
    cells = points.select(*(voxel(F.col(c), leaf).alias(f"v{c}") for c in XYZ)).groupBy("vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"))
    return global_rank(cells, ["vx", "vy", "vz"], F.col("vx"), "voxel_id")
