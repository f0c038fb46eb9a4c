"""Plane fitting by random samples, with the stopping rule of the sequential algorithm computed in windows.

Samples come from a counter-based generator of plain integer arithmetic, so any engine draws the same. All
candidates are scored in one pass: they are few and of fixed number, so they are sent to the points, and only a
count for each candidate and partition is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plane_distance, plane_from_points
from ..shipping import ship
from ..staging import Staging
from .stats import XYZ, ranked, xyz

#: Fixed values of the generator.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2147483647
EPSILON = 2.220446049250313e-16
#: Points that are held against all candidates at once.
CHUNK = 1024


def candidates(points: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(t, a, b, c, d): a plane for each iteration, null where its three points repeat or are collinear."""
    rows = ranked(points, "pid").select("rk", *XYZ)
    n = rows.count()
    spark = points.sparkSession
    if n < 3:
        return spark.createDataFrame([], "t bigint, a double, b double, c double, d double")
    u = [F.col("id") * 3 + (j + 1) for j in range(3)]
    index = [((v * v * MULTIPLIER + v * INCREMENT + seed) % MODULUS) % n for v in u]
    draws = spark.range(iterations).select(F.col("id").alias("t"), F.explode(F.array(*(F.struct(F.lit(j).alias("j"), i.alias("rk")) for j, i in enumerate(index)))).alias("s")).select("t", "s.j", "s.rk")
    taken = rows.join(F.broadcast(draws), "rk")  # 3 * iterations rows
    pick = lambda j, c: F.max(F.when(F.col("j") == j, F.col(c)))
    three = taken.groupBy("t").agg(F.count_distinct("rk").alias("k"), *(pick(j, c).alias(f"{c}{j}") for j in range(3) for c in XYZ))
    plane = plane_from_points([tuple(F.col(f"{c}{j}") for c in XYZ) for j in range(3)])
    return three.select("t", *(F.when(F.col("k") == 3, v).alias(name) for v, name in zip(plane, "abcd", strict=True)))


def scores(points: DataFrame, planes: DataFrame, threshold: float) -> DataFrame:
    """(t, inliers) for each valid candidate: points with |distance| <= threshold.

    The candidates, as many rows as iterations, go to the tasks; each counts over whole batches of points and sends on one
    row a candidate, so no pair of a point and a plane is ever a row.
    """
    ship(points.sparkSession)
    rows = planes.where(F.col("a").isNotNull()).collect()
    t = np.array([r["t"] for r in rows], np.int64)
    a, b, c, d = (np.array([r[n] for r in rows], np.float64)[:, None] for n in "abcd")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inliers, seen = np.zeros(len(t), np.int64), False
        for batch in batches:
            at = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(3)]
            seen |= batch.num_rows > 0
            for k in range(0, batch.num_rows, CHUNK):
                x, y, z = (v[None, k : k + CHUNK] for v in at)
                inliers += (np.abs(a * x + b * y + c * z + d) <= threshold).sum(1)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(inliers)], ["t", "inliers"])

    return points.select(*XYZ).mapInArrow(count, "t bigint, inliers bigint").groupBy("t").agg(F.sum("inliers").alias("inliers"))


def pretest(points: DataFrame, planes: DataFrame, threshold: float, sample: int = 64, share: float = 0.15, after: int = 10) -> DataFrame:
    """Drops candidates after the first ``after`` of which less than ``share`` of the first points (by pid) are inliers."""
    first = points.orderBy("pid").limit(sample)
    n = first.count()
    good = scores(first, planes, threshold).where(F.col("inliers") >= share * n).select("t")
    kept = planes.join(F.broadcast(good.withColumn("_g", F.lit(True))), "t", "left").where((F.col("t") <= after) | F.col("_g"))
    return kept.drop("_g")


def executed(planes: DataFrame, scored: DataFrame, n: int, iterations: int, confidence: float) -> DataFrame:
    """(t, inliers, cap) of the iterations that the sequential algorithm would have run.

    Each new best count w n lowers the cap to log(1 - p) / log(1 - w^3); iterations from the cap on are not run. The
    windows run over ``iterations`` rows.
    """
    p = min(max(confidence, 0.5), 0.9999)
    spark = planes.sparkSession
    every = spark.range(iterations).select(F.col("id").alias("t")).join(scored, "t", "left").withColumn("inliers", F.coalesce("inliers", F.lit(0)).cast("long"))
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    w = F.col("inliers") / F.lit(float(n))
    miss = F.least(F.greatest(1 - w * w * w, F.lit(EPSILON)), F.lit(1 - EPSILON))
    need = F.when(F.abs(F.log(miss)) > 1e-7, F.ceil(F.log(F.lit(1 - p)) / F.log(miss)).cast("long"))
    rows = every.withColumn("rec", F.col("inliers") > F.coalesce(F.max("inliers").over(before), F.lit(0)))
    rows = rows.withColumn("need", F.when(F.col("rec") & (need > 0), need))
    return rows.withColumn("cap", F.least(F.lit(iterations).cast("long"), F.coalesce(F.min("need").over(before), F.lit(iterations).cast("long")))).where("t < cap").select("t", "inliers", "cap")


def fit_plane(points: DataFrame, threshold: float, iterations: int, seed: int, confidence: float = 0.99, test_first: bool = False) -> DataFrame:
    """One row: t, inliers, executed, a, b, c, d of the best plane (most inliers, then the least t); none if n < 3."""
    staging = Staging(points.sparkSession, "plane")
    points = staging.save(points.select("pid", *XYZ))
    n = points.count()
    planes = staging.save(candidates(points, iterations, seed))  # ``iterations`` rows
    if n < 3:
        return points.sparkSession.createDataFrame([], "t bigint, inliers bigint, executed bigint, a double, b double, c double, d double")
    if test_first:
        planes = pretest(points, planes, threshold)
    scored = staging.save(scores(points, planes, threshold))
    if test_first:
        run = scored.withColumn("cap", F.lit(iterations).cast("long"))
    else:
        run = executed(planes, scored, n, iterations, confidence)
    best = run.agg(F.max(F.struct("inliers", (-F.col("t")).alias("m"))).alias("b"), F.count(F.lit(1)).alias("executed")).select((-F.col("b.m")).alias("t"), F.col("b.inliers").alias("inliers"), "executed")
    return best.where("inliers > 0").join(planes, "t")


def split(points: DataFrame, plane: DataFrame, threshold: float) -> DataFrame:
    """Adds is_inlier for a one-row plane; a point whose distance is not a number is an outlier."""
    d = plane_distance(xyz(), tuple(F.col(f"_{c}") for c in "abcd"))
    sent = F.broadcast(plane.select(*(F.col(c).alias(f"_{c}") for c in "abcd")))
    near = F.coalesce((F.abs(d) <= threshold) & ~F.isnan(d), F.lit(False))
    return points.join(sent).withColumn("is_inlier", near).drop("_a", "_b", "_c", "_d")
