"""Neighbour joins on a grid of cells.

A distance predicate alone would be planned as a nested loop. Here the query side is multiplied over the cells that
its ball can touch, and both sides meet by an equality of cells, which Spark shuffles, spills and splits like any join;
the exact distance decides what stays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cell, distance_sq, morton30
from ..staging import Staging
from .stats import XYZ, bounding_box, global_rank, xyz


#: Places in a cell twice as wide as the first radius of ``knn_join``, for each neighbour sought, at most.
_CROWD = 8


def _celled(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({f"c{c}": cell(F.col(c), size) for c in XYZ})


def _around(rings: int) -> Column:
    steps = range(-rings, rings + 1)
    return F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(d, XYZ, strict=True))) for d in ((i, j, k) for i in steps for j in steps for k in steps)))


def radius_join(queries: DataFrame, points: DataFrame, radius: float, by: Sequence[str] = (), rings: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """(qid, pid, d2) for all points within the radius, the query's own point too: d2 <= radius^2 in single precision.

    Cells are radius / rings wide. More rings make smaller cells, for clouds whose dense cells hold too many pairs.
    carry: further columns of the points. The query side has many more rows than its files let Spark expect, so it
    is never left to Spark to broadcast it.
    """
    size = radius / rings * (1 + 1e-6)  # a rounding of the predicate never reaches past the outermost ring
    q = _celled(queries.select(*by, F.col("pid").alias("qid"), *(F.col(c).alias(f"q{c}") for c in XYZ)).withColumns({c: F.col(f"q{c}") for c in XYZ}), size)
    q = q.withColumn("_o", F.explode(_around(rings))).select(*by, "qid", *(f"q{c}" for c in XYZ), *((F.col(f"c{c}") + F.col(f"_o.{c}")).alias(f"c{c}") for c in XYZ))
    p = _celled(points.select(*by, "pid", *XYZ, *carry), size)
    d2 = distance_sq(xyz("q"), xyz())
    r2 = F.lit(radius).cast("float") * F.lit(radius).cast("float")
    return q.hint("merge").join(p, [*by, "cx", "cy", "cz"]).withColumn("d2", d2).where(F.col("d2") <= r2).select(*by, "qid", "pid", "d2", *XYZ, *carry)


def radius_query(points: DataFrame, query: tuple[float, float, float], radius: float, max_nn: int | None = None) -> DataFrame:
    """Neighbours of one point: a filter and, with max_nn, the nearest by (d2, pid). 0 and None mean all."""
    q = tuple(F.lit(v).cast("float") for v in query)
    r = F.lit(radius).cast("float")
    # the ball's box prunes files and row groups where the cloud is laid out by place; a little wider than rounding can reach
    for v, c in zip(query, XYZ, strict=True):
        wide = radius * (1 + 1e-5) + abs(v) * 1e-6
        points = points.where(F.col(c).between(F.lit(v - wide).cast("float"), F.lit(v + wide).cast("float")))
    hits = points.withColumn("d2", distance_sq(q, xyz())).where(F.col("d2") <= r * r).select("pid", "d2")
    return hits.orderBy("d2", "pid").limit(max_nn) if max_nn else hits


def nearest(pairs: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k nearest of each query among joined pairs, ranked by (d2, pid) from 1; a window group limit prunes early."""
    w = Window.partitionBy(*by, "qid").orderBy("d2", "pid")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _places(points: DataFrame, most: int) -> DataFrame:
    """One row for each place that points lie on: its least pid, x, y, z, and its ``most`` least pids in order.

    The ranks prune ahead of the shuffle, so a place of very many points is never gathered.
    """
    w = Window.partitionBy(*XYZ).orderBy("pid")
    first = points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return first.groupBy(*XYZ).agg(F.array_sort(F.collect_list("pid")).alias("pids")).select(F.element_at("pids", 1).alias("pid"), *XYZ, "pids")


def _crowds(places: DataFrame, size: float) -> DataFrame:
    """Places and points of every occupied cell."""
    return _celled(places, size).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("places"), F.sum(F.size("pids")).alias("points"))


def knn_join(points: DataFrame, k: int) -> DataFrame:
    """Exact k nearest other points of every point: (qid, rank, pid, d2, x, y, z). Points without three finite
    coordinates take no part.

    Points of one place share their neighbours, and of a place the k + 1 least pids are all that (d2, pid) can rank among
    the k nearest of anything. So places are searched, each for the k + 1 nearest points, its own too; a point's
    neighbours are those of its place without itself. The radius starts where the densest cells hold few places, and
    doubles: a round takes the places with k + 1 points in a cell about them, and those that find as many within the radius are
    done. Rounds are as many as doublings up to the cloud's diagonal at most.
    """
    staging = Staging(points.sparkSession, "knn")
    finite = " AND ".join(f"abs({c}) < float('infinity')" for c in XYZ)
    points = staging.save(points.select("pid", *XYZ).where(finite))
    box = bounding_box(points).first()
    if not box["n"] or box["n"] < 2 or k < 1:
        return points.select(F.col("pid").alias("qid"), F.lit(1).alias("rank"), "pid", F.lit(0).cast("float").alias("d2"), *XYZ).limit(0)
    extent = [max(float(box[f"max_{c}"]) - float(box[f"min_{c}"]), 0.0) for c in XYZ]
    diagonal = math.sqrt(sum(e * e for e in extent)) * (1 + 1e-5) + 1e-12
    k = min(k, box["n"] - 1)
    places = staging.save(_places(points, k + 1))
    solid = [e for e in extent if e > 1e-3 * diagonal] or [diagonal]
    radius = min(1.5 * (math.prod(solid) * (k + 1) / places.count()) ** (1 / len(solid)), diagonal)
    for _ in range(20):
        if _crowds(places, 2 * radius).agg(F.max("places")).first()[0] <= _CROWD * (k + 1):
            break
        radius /= 2
    left, done = places, None
    while True:
        last = radius >= diagonal
        ready = left
        if not last:
            full = _crowds(places, 2 * radius).where(F.col("points") > k).select("cx", "cy", "cz")
            ready = _celled(left, 2 * radius).join(full.hint("merge"), ["cx", "cy", "cz"], "left_semi").select(*left.columns)
        pairs = radius_join(ready, places, radius, carry=("pids",)).select("qid", "d2", *XYZ, F.explode("pids").alias("pid"))
        near = nearest(pairs, k + 1).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("d2", "pid", *XYZ))).alias("near"))
        found = staging.save(near.where(F.size("near") > k))
        done = found if done is None else done.unionByName(found)
        if not last:
            left = staging.save(left.join(found.select(F.col("qid").alias("pid")).hint("merge"), "pid", "left_anti"))
        if last or left.isEmpty():
            break
        radius = min(2 * radius, diagonal)
    near = places.select(F.col("pid").alias("qid"), *XYZ).join(done.hint("merge"), "qid").select(*XYZ, "near")
    each = points.join(staging.save(near).hint("merge"), list(XYZ)).select(F.col("pid").alias("qid"), F.slice(F.filter("near", lambda p: p["pid"] != F.col("pid")), 1, k).alias("near"))
    return each.select("qid", F.posexplode("near").alias("rank", "_p")).select("qid", (F.col("rank") + 1).alias("rank"), *(F.col(f"_p.{c}").alias(c) for c in ("pid", "d2", *XYZ)))


def with_morton(points: DataFrame) -> DataFrame:
    """Adds the 30-bit code over the cloud's own box (one row, joined back)."""
    box = bounding_box(points).select(*(F.col(f"min_{c}").alias(f"_{c}") for c in XYZ), F.greatest(*(F.col(f"max_{c}").cast("double") - F.col(f"min_{c}").cast("double") for c in XYZ)).alias("_extent"))
    joined = points.join(F.broadcast(box))  # one row
    return joined.withColumn("morton", morton30(*xyz(), tuple(F.col(f"_{c}") for c in XYZ), F.col("_extent"))).drop("_x", "_y", "_z", "_extent")


def approx_morton_join(points: DataFrame, radius: float, window: int = 128) -> DataFrame:
    """Approximate neighbours: points within the radius among those at most ``window`` places away in Z-order."""
    ranked = global_rank(with_morton(points), ["morton", "pid"], F.shiftright("morton", 18))
    b = F.expr(f"rk div {window}")
    q = ranked.select(F.col("pid").alias("qid"), F.col("rk").alias("qrk"), *(F.col(c).alias(f"q{c}") for c in XYZ), F.explode(F.array(b - 1, b, b + 1)).alias("b"))
    p = ranked.select("pid", "rk", *XYZ, b.alias("b"))
    r = F.lit(radius).cast("float")
    met = q.join(p, "b").where(F.abs(F.col("rk") - F.col("qrk")) <= window)
    return met.withColumn("d2", distance_sq(xyz("q"), xyz())).where(F.col("d2") <= r * r).select("qid", "pid", "d2")


def morton_sorted(points: DataFrame, partitions: int | None = None) -> DataFrame:
    """The cloud laid out in Z-order: ranges of codes, sorted inside each, so that later scans read neighbours together."""
    coded = with_morton(points)
    ranged = coded.repartitionByRange(partitions, "morton", "pid") if partitions else coded.repartitionByRange("morton", "pid")
    return ranged.sortWithinPartitions("morton", "pid")
