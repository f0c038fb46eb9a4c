"""Clusters as connected components: of points within a tolerance, of voxels, of 2.5D cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cluster_color, voxel
from ..shipping import ship
from ..staging import Staging
from .search import radius_join
from .stats import XYZ, ranked

#: Edges up to which one task labels the graph (16 bytes each); beyond it, rounds of joins do.
ONE_TASK_EDGES = 2_000_000


def _label(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least node of each component, by hooking and pointer jumping over arrays."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        was = parent.copy()
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
        if np.array_equal(was, parent):
            return nodes, nodes[parent]


def _contract(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(u, v): each node linked to the least one of its component, for blocks of about ``most`` edges as they come."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def star() -> pa.RecordBatch:
        nodes, labels = _label(np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held]))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) >= most:
            yield star()
            held = []
    if held:
        yield star()


def connected_components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, label) for the nodes of edges (u, v), bigint; label is the least node of the component.

    The staged edges are counted: a graph of bounded size is labelled in one task. A larger one is contracted first:
    every task links the nodes it meets straight to the least one in reach, block by block, which leaves about one edge a
    node and block and needs no shuffle. What is left goes to one task if it is within the bound now, else through rounds
    that take the least label among neighbours and then the label's own label, each a shuffle by node.
    """
    ship(edges.sparkSession)
    staging = Staging(edges.sparkSession, "components")
    edges = staging.save(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    few = edges.count() <= one_task
    if not few:
        edges = staging.save(edges.mapInArrow(lambda batches: _contract(batches, ONE_TASK_EDGES), "u bigint, v bigint"))
        few = edges.count() <= one_task
    if few:
        return edges.coalesce(1).mapInArrow(lambda batches: _contract(batches, one_task + 1), "u bigint, v bigint").toDF("node", "label")
    both = staging.save(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = staging.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("l"))
        jump = step.join(labels.select(F.col("node").alias("l"), F.col("label").alias("up")), "l", "left")
        new = staging.save(jump.select("node", F.least("l", F.coalesce("up", "l")).alias("label"), "was"))
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def euclidean_clusters(points: DataFrame, tolerance: float, least: int = 1, most: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(pid, cluster_id, size): components of points at most ``tolerance`` apart, named by their least pid.

    Clusters smaller than ``least`` or larger than ``most`` are left out. pairs: a radius join to be used again.
    """
    t = F.lit(tolerance).cast("float")
    joined = pairs.where(F.col("d2") <= t * t) if pairs is not None else radius_join(points, points, tolerance)
    labels = connected_components(joined.where("qid < pid").select(F.col("qid").alias("u"), F.col("pid").alias("v")))
    named = points.select("pid").join(labels, points["pid"] == labels["node"], "left").select("pid", F.coalesce("label", "pid").cast("long").alias("cluster_id"))
    return sized(named, least, most)


def sized(named: DataFrame, least: int, most: int | None) -> DataFrame:
    sizes = named.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    if most is not None:
        sizes = sizes.where(F.col("size") <= most)
    return named.join(sizes, "cluster_id")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """(cluster_id, size, ordinal): ordinals from 0 in the order of the clusters' least points."""
    rows = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return ranked(Staging(clusters.sparkSession, "sizes").save(rows), "cluster_id", "ordinal")


def cluster_lists(clusters: DataFrame, width: int = 4096) -> DataFrame:
    """(cluster_id, chunk, pids): the nested form, ids ascending, in chunks of the ids from chunk * width on, so that a
    row holds ``width`` ids at most however large its cluster is."""
    chunk = F.floor(F.col("pid") / width).cast("long").alias("chunk")
    return clusters.groupBy("cluster_id", chunk).agg(F.array_sort(F.collect_list("pid")).alias("pids"))


def colors(sizes: DataFrame) -> DataFrame:
    r, g, b = cluster_color(F.col("ordinal"))
    return sizes.select("cluster_id", "ordinal", r.alias("r"), g.alias("g"), b.alias("b"))


def _cell_clusters(points: DataFrame, keys: dict[str, Column], least: int, most: int | None) -> DataFrame:
    """Components of occupied cells that touch, corners included; a cell is named by its least pid."""
    names = list(keys)
    celled = points.select("pid", *(c.alias(n) for n, c in keys.items()))
    cells = celled.groupBy(*names).agg(F.min("pid").alias("first"))
    steps = [()]
    for _ in names:
        steps = [(*s, d) for s in steps for d in (-1, 0, 1)]
    forward = [s for s in steps if s > tuple(0 for _ in names)]  # half of the neighbours, the rest by symmetry
    moves = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip(s, names, strict=True))) for s in forward))
    moved = cells.withColumn("_o", F.explode(moves)).select(F.col("first").alias("u"), *((F.col(n) + F.col(f"_o.{n}")).alias(n) for n in names))
    edges = moved.join(cells, names).select("u", F.col("first").alias("v"))
    labels = connected_components(edges)
    named = cells.join(labels, cells["first"] == labels["node"], "left").select(*names, F.coalesce("label", "first").cast("long").alias("cluster_id"))
    return sized(celled.join(named, names).select("pid", "cluster_id"), least, most)


def voxel_clusters(points: DataFrame, leaf: float, least: int = 1, most: int | None = None) -> DataFrame:
    """26-connected components of occupied voxels: (pid, cluster_id, size)."""
    return _cell_clusters(points, {f"v{c}": voxel(F.col(c), leaf) for c in XYZ}, least, most)


def grid_clusters(points: DataFrame, size: float, least: int = 1, most: int | None = None) -> DataFrame:
    """8-connected components of occupied xy cells: (pid, cluster_id, size)."""
    return _cell_clusters(points, {"vx": voxel(F.col("x"), size), "vy": voxel(F.col("y"), size)}, least, most)
