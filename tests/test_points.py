"""Operators against NumPy, and the edge cases of clustering and plane fitting."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.functions import voxel
from pointloom.operators import cluster, features, filters, plane, search, stats
from pointloom.sources import tables

SCHEMA = "pid bigint, x float, y float, z float"


def cloud(spark, a):
    return spark.createDataFrame([(i, float(p[0]), float(p[1]), float(p[2])) for i, p in enumerate(np.asarray(a, np.float32))], SCHEMA)


def sq(a):
    a = np.asarray(a, np.float32)
    d = [a[:, None, i] - a[None, :, i] for i in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


@pytest.fixture(scope="module")
def gauss():
    return np.random.default_rng(42).normal(0, 2, (400, 3)).astype(np.float32)


@pytest.mark.parametrize("rings", [1, 2])
def test_radius_join_equals_brute_force(spark, gauss, rings):
    p = cloud(spark, gauss)
    got = {(r.qid, r.pid) for r in search.radius_join(p, p, 0.7, rings=rings).collect()}
    r = np.float32(0.7)
    assert got == set(zip(*map(lambda v: v.tolist(), np.nonzero(sq(gauss) <= r * r)), strict=True))


def test_radius_join_is_planned_as_an_equality_join(spark, gauss):
    p = cloud(spark, gauss)
    plan = search.radius_join(p, p, 0.7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_not_a_number_is_nobodys_neighbour(spark):
    p = cloud(spark, [[0, 0, 0], [0.1, 0, 0], [math.nan, 0, 0]])
    assert {(r.qid, r.pid) for r in search.radius_join(p, p, 1.0).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_knn_equals_brute_force(spark, gauss):
    d = sq(gauss)
    want = {(i, r + 1, j) for i in range(len(gauss)) for r, j in enumerate([j for j in np.lexsort((np.arange(len(gauss)), d[i])) if j != i][:6])}
    assert {(r.qid, r.rank, r.pid) for r in search.knn_join(cloud(spark, gauss), 6).collect()} == want


def test_knn_of_few_points(spark):
    assert search.knn_join(cloud(spark, [[0, 0, 0]]), 3).count() == 0
    assert search.knn_join(cloud(spark, [[0, 0, 0], [0, 0, 0], [5, 5, 5]]), 10).count() == 6


def test_knn_of_repeated_places_and_a_dense_core(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate((rng.normal(0, 0.001, (200, 3)), rng.uniform(-100, 100, (40, 3)), np.repeat(rng.normal(50, 1, (5, 3)), 9, 0), [[0, 0, 0]] * 4, [[-0.0, 0, 0]] * 4)).astype(np.float32)
    d = sq(a)
    want = {(i, r + 1, j) for i in range(len(a)) for r, j in enumerate([j for j in np.lexsort((np.arange(len(a)), d[i])) if j != i][:6])}
    odd = np.concatenate((a, [[math.nan, 0, 0], [0, math.inf, 0]]))
    assert {(r.qid, r.rank, r.pid) for r in search.knn_join(cloud(spark, odd), 6).collect()} == want


def test_cells_of_queries_are_never_broadcast(spark, gauss):
    """27 rows for each query: more than Spark expects of the files that they come from."""
    p = cloud(spark, gauss)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for d in (search.radius_join(p, p, 0.7), search.knn_join(p, 3)):
            assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_radius_query_limits(spark, gauss):
    p = cloud(spark, gauss)
    every = search.radius_query(p, (0.0, 0.0, 0.0), 2.0).collect()
    assert len(search.radius_query(p, (0.0, 0.0, 0.0), 2.0, 0).collect()) == len(every)
    assert [r.pid for r in search.radius_query(p, (0.0, 0.0, 0.0), 2.0, 5).collect()] == [r.pid for r in sorted(every, key=lambda r: (r.d2, r.pid))[:5]]


def test_outlier_removal_of_a_mixture(spark):
    rng = np.random.default_rng(42)
    a = np.concatenate((rng.normal(0, 1, (270, 3)), rng.uniform(-20, 20, (30, 3)))).astype(np.float32)
    d = np.sqrt(sq(a).astype(float))
    np.fill_diagonal(d, np.inf)
    mean = np.sort(d, 1)[:, :10].mean(1)
    want = set(np.flatnonzero(mean <= mean.mean() + mean.std()).tolist())
    assert {r.pid for r in filters.outlier_removal(cloud(spark, a), 10, 1.0).collect()} == want


def test_empty_cloud(spark):
    p = spark.createDataFrame([], SCHEMA)
    assert stats.voxel_grid(p, 0.5).count() == 0
    assert search.radius_join(p, p, 1.0).count() == 0
    assert cluster.euclidean_clusters(p, 0.1).count() == 0
    assert plane.fit_plane(p, 0.1, 10, 0).count() == 0
    assert filters.outlier_removal(p, 3, 1.0, 0.5).count() == 0


def test_voxels_of_negative_coordinates(spark):
    rows = spark.createDataFrame([(-0.5,), (-1.0,), (0.0,), (1.5,)], "v float").select(voxel(F.col("v"), 1.0).alias("c"))
    assert [r.c for r in rows.collect()] == [-1, -1, 0, 1]


def test_adaptive_leaf(spark):
    leaf = stats.adaptive_leaf(tables.modular_cloud(spark, 1000), 1000)
    assert leaf == pytest.approx((96 * 88 * 82 / 1000) ** (1 / 3), rel=1e-6)


def blobs(n, gap=5.0, seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-0.04, 0.04, (n, 3)) + [gap * k, 0, 0] for k in range(2)])


@pytest.mark.parametrize(
    ("points", "tolerance", "least", "most", "sizes"),
    [
        ([[1, 2, 3]], 0.5, 1, None, [1]),
        (blobs(50), 0.15, 1, None, [50, 50]),
        (np.concatenate((blobs(5), blobs(20)[20:] + [20, 0, 0])), 0.15, 10, None, [20]),
        (np.concatenate((blobs(30)[:30], blobs(5)[5:])), 0.15, 1, 10, [5]),
        (np.random.default_rng(2).normal(0, 0.02, (200, 3)), 0.2, 1, None, [200]),
        ([[0, 0, 0], [1, 0, 0]], 0.999, 1, None, [1, 1]),
        ([[0, 0, 0], [1, 0, 0]], 1.0, 1, None, [2]),
    ],
)
def test_cluster_cases(spark, points, tolerance, least, most, sizes):
    got = cluster.cluster_sizes(cluster.euclidean_clusters(cloud(spark, points), tolerance, least, most))
    assert sorted(r["size"] for r in got.collect()) == sorted(sizes)


def brute_components(a, tolerance):
    near = sq(a) <= np.float32(tolerance) * np.float32(tolerance)
    label = [-1] * len(a)
    for i in range(len(a)):
        if label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if label[j] < 0:
                        label[j] = i
                        todo.append(j)
    return label


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, one_task):
    a = np.random.default_rng(7).uniform(-1, 1, (300, 3))
    p = cloud(spark, a)
    monkeypatch.setattr(cluster.connected_components, "__defaults__", (one_task,))
    got = {r.pid: r.cluster_id for r in cluster.euclidean_clusters(p, 0.3).collect()}
    assert [got[i] for i in range(len(a))] == brute_components(np.asarray(a, np.float32), 0.3)


def test_contraction_keeps_components():
    rng = np.random.default_rng(5)
    u, v = rng.integers(0, 400, (2, 300))
    batches = [pa.RecordBatch.from_arrays([pa.array(u[i : i + 7]), pa.array(v[i : i + 7])], ["u", "v"]) for i in range(0, 300, 7)]
    want = dict(zip(*cluster._label(u, v), strict=True))
    for most in (1, 20, 10**6):
        stars = list(cluster._contract(iter(batches), most))
        got = dict(zip(*cluster._label(*(np.concatenate([b.column(i).to_numpy() for b in stars]) for i in (0, 1))), strict=True))
        assert got == want and (most < 10**6 or len(stars) == 1)
    assert list(cluster._contract(iter([]), 5)) == []


def test_a_long_path_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.label for r in cluster.connected_components(edges, 0).collect()} == {0}


def test_plane_through_half_of_the_points(spark):
    rng = np.random.default_rng(42)
    a = np.concatenate((np.c_[rng.uniform(-20, 20, (500, 2)), rng.normal(10, 0.01, 500)], rng.uniform(-20, 20, (500, 3))))
    p = cloud(spark, a)
    best = plane.fit_plane(p, 0.1, 1000, 42).first()
    assert best.inliers >= 450 and abs(best.c) > 0.9 and abs(best.d) >= 9
    parts = plane.split(p, plane.fit_plane(p, 0.1, 1000, 42), 0.1)
    assert parts.where("is_inlier").count() == best.inliers and parts.count() == 1000


def test_normals_of_a_tilted_plane(spark):
    rng = np.random.default_rng(42)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    flat = np.c_[rng.uniform(-10, 10, (500, 2)), rng.normal(0, 0.01, 500)]
    rows = features.normals_radius(cloud(spark, flat @ turn.T), 2.5).collect()
    true = turn[:, 2]
    good = [abs(r.nx * true[0] + r.ny * true[1] + r.nz * true[2]) > 0.99 for r in rows if r.valid]
    assert len(good) > 450 and np.mean(good) >= 0.95


def test_normals_face_the_viewpoint_and_match_eigh(spark, gauss):
    rows = features.normals_radius(cloud(spark, gauss), 1.5, (0.0, 0.0, 100.0)).collect()
    near = sq(gauss) <= np.float32(1.5) * np.float32(1.5)
    for r in rows:
        n = near[r.pid]
        if not r.valid:
            assert (r.nx, r.ny, r.nz) == (0, 0, 0)
            continue
        value, vector = np.linalg.eigh(np.cov(gauss[n].astype(float).T, bias=True))
        if value[1] - value[0] > 1e-3:
            assert abs(vector[:, 0] @ [r.nx, r.ny, r.nz]) > 1 - 1e-6
            assert r.curvature == pytest.approx(value[0] / value.sum(), abs=1e-6)
        x, y, z = gauss[r.pid].astype(float)
        assert -x * r.nx - y * r.ny + (100 - z) * r.nz >= -1e-9


def test_elevation_grid_without_frames(spark):
    p = cloud(spark, [[0, 0, 0], [0.1, 0, 1], [0.9, 0.9, 5]])
    g = {r.pid: r.is_ground for r in filters.ground_split(filters.elevation_cells(p, 0.5), 0.2, drop_singletons=False).collect()}
    assert g == {0: True, 1: False, 2: True}
    assert filters.ground_split(filters.elevation_cells(p, 0.5), 0.2).count() == 2


def test_walkthrough(spark):
    from pointloom.plans.pipelines import walkthrough

    a = np.random.default_rng(42).normal(0, 0.03, (400, 3))
    stages = walkthrough(cloud(spark, a))
    rows = stages["06_normals"].collect()
    assert stages["00_input"].count() == 1400 and 0 < len(rows) <= stages["04_ground_plane_removed"].count() < stages["01_downsampled"].count()
    assert all(-r.x * r.nx - r.y * r.ny - r.z * r.nz >= -1e-5 for r in rows)


def test_z_order_layout(spark):
    p = search.morton_sorted(tables.modular_cloud(spark, 2000), 4)
    codes = [r.morton for r in p.collect()]
    assert codes == sorted(codes) and len(codes) == 2000


def test_hit_rates(spark):
    from pointloom.sources import simstats

    lines = spark.createDataFrame([("f", "a.hits 30 # x"), ("f", "a.misses 10"), ("f", "---- begin"), ("f", "b.hits 1e1")], "file string, value string")
    got = simstats.rates(simstats.parse(lines, ["file"]), ["file"]).collect()
    assert [(r.unit, r.hit_rate) for r in got] == [("a", 0.75)]
