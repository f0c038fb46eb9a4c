"""Registered queries of the point-cloud engine, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import morton63
from .operators import cluster, features, filters, plane, search, stats
from .operators.stats import XYZ, xyz
from .plans.pipelines import Config3D, Config25D, pipeline_3d, pipeline_25d, stage_counts, walkthrough
from .sources import pcd, simstats, sinks, tables
from .staging import Staging

EMB = "SELECT vec_id AS pid, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z FROM embeddings"
LI = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS FLOAT) AS x, CAST(l_extendedprice / 1000 AS FLOAT) AS y, CAST(l_discount * 100 + 0.0 AS FLOAT) AS z FROM lineitem"
EVT = "SELECT CAST(ts AS DATE) AS frame, event_id AS pid, CAST(user_id AS FLOAT) AS x, CAST(hour(ts) AS FLOAT) AS y, CAST(value AS FLOAT) AS z FROM events"
PART = "SELECT p_partkey AS pid, CAST(p_size AS FLOAT) AS x, CAST(p_retailprice / 100 AS FLOAT) AS y, CAST(p_partkey % 50 AS FLOAT) AS z FROM part"
SYN = "SELECT i AS pid, CAST((i * 3 + 1) % 97 AS FLOAT) AS x, CAST((i * 5 + 7) % 89 AS FLOAT) AS y, CAST((i * 7 + 13) % 83 AS FLOAT) AS z FROM (SELECT row_number() OVER () - 1 AS i FROM lineitem) t"
QUERY, RADIUS = (0.05, -0.05, 0.1), 0.1
LEAF, TOL = 2.5, 0.05
PLANE = dict(threshold=0.05, iterations=200, seed=7)

_q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _q[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _vox(c: str, leaf: float = LEAF) -> str:
    return f"CAST(floor({c} * CAST({1 / leaf!r} AS FLOAT)) AS INT)"


def _d2(a: str = "q.", b: str = "p.") -> str:
    return " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in XYZ)


def _r2(r: float) -> str:
    return f"CAST({r} AS FLOAT) * CAST({r} AS FLOAT)"


def _pairs(r: float, src: str = "e") -> str:
    return f"SELECT q.pid AS qid, p.pid AS pid, {_d2()} AS d2, p.x AS x, p.y AS y, p.z AS z FROM {src} q JOIN {src} p ON {_d2()} <= {_r2(r)}"


def _modular(spark, sf):
    """The modular cloud, with as many points as lineitem has rows."""
    return tables.modular_cloud(spark, tables.read(spark, sf, "lineitem").count())


# -- one-pass kernels --------------------------------------------------------------------------------------------------


@_query(f"WITH p AS ({LI}) SELECT {_vox('x')} AS vx, {_vox('y')} AS vy, {_vox('z')} AS vz, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM p GROUP BY 1, 2, 3")
def voxel_grid(spark, sf):
    v = stats.voxel_grid(tables.from_lineitem(spark, sf), LEAF)
    return v.select("vx", "vy", "vz", "n", *(F.round(c, 4).alias(c) for c in XYZ))


@_query(f"WITH p AS ({LI}), v AS (SELECT count(*) AS n FROM p GROUP BY {_vox('x')}, {_vox('y')}, {_vox('z')}) SELECT count(*) AS n_voxels, CAST(sum(n) AS BIGINT) AS n_points, max(n) AS largest FROM v")
def voxel_count(spark, sf):
    v = stats.voxel_grid(tables.from_lineitem(spark, sf), LEAF)
    return v.agg(F.count(F.lit(1)).alias("n_voxels"), F.sum("n").alias("n_points"), F.max("n").alias("largest"))


@_query(f"WITH p AS ({LI}), v AS (SELECT {_vox('x')} AS vx, {_vox('y')} AS vy, {_vox('z')} AS vz, count(*) AS n FROM p GROUP BY 1, 2, 3) SELECT vx, vy, vz, n, row_number() OVER (ORDER BY vx, vy, vz) - 1 AS voxel_id FROM v")
def voxel_ids(spark, sf):
    return stats.voxel_ids(tables.from_lineitem(spark, sf), LEAF)


@_query(f"WITH p AS ({LI}) SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM p")
def bbox(spark, sf):
    return stats.bounding_box(tables.from_lineitem(spark, sf))


@_query(f"WITH p AS ({SYN}) SELECT CAST(sum(floor((x - 41) * (x - 41) + (y - 29) * (y - 29) + (z - 37) * (z - 37))) AS BIGINT) AS checksum FROM p")
def l2_checksum(spark, sf):
    return stats.l2_checksum(_modular(spark, sf), (41, 29, 37))


@_query(f"""WITH p AS ({SYN}), s AS (SELECT count(*) AS n, sum(CAST(x + y + z AS BIGINT)) AS s, sum(CAST(x + y + z AS BIGINT) * CAST(x + y + z AS BIGINT)) AS q FROM p),
m AS (SELECT n, CAST(floor(s / n) AS BIGINT) AS mean, CAST(floor(q / n - (s / n) * (s / n)) AS BIGINT) AS variance FROM s) SELECT n, mean, variance, xor(mean << 32, variance) AS checksum FROM m""")
def reduction_stats(spark, sf):
    return stats.reduction_stats(_modular(spark, sf))


@_query(f"WITH p AS ({SYN}) SELECT count(*) AS n FROM p WHERE x + y + z <= 120")
def masked_filter(spark, sf):
    return stats.masked_filter(_modular(spark, sf), 120.0)


@_query(f"WITH p AS ({SYN}) SELECT count(*) AS n FROM p WHERE (17 - x) * (17 - x) + (23 - y) * (23 - y) + (31 - z) * (31 - z) <= 2025")
def radius_count(spark, sf):
    return search.radius_query(_modular(spark, sf), (17.0, 23.0, 31.0), 45.0).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH p AS ({SYN}), l AS (SELECT x, y, z, lead(x, 1) OVER w AS x1, lead(y, 1) OVER w AS y1, lead(z, 1) OVER w AS z1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2, lead(z, 2) OVER w AS z2 FROM p WINDOW w AS (ORDER BY pid))
SELECT count(*) AS n, CAST(sum(floor(abs((y1 - y) * (z2 - z) - (z1 - z) * (y2 - y)))) AS BIGINT) AS sum_x, CAST(sum(floor(abs((z1 - z) * (x2 - x) - (x1 - x) * (z2 - z)))) AS BIGINT) AS sum_y,
CAST(sum(floor(abs((x1 - x) * (y2 - y) - (y1 - y) * (x2 - x)))) AS BIGINT) AS sum_z FROM l WHERE x2 IS NOT NULL""")
def triple_cross(spark, sf):
    return stats.triple_cross(_modular(spark, sf))


# -- neighbour searches ------------------------------------------------------------------------------------------------

_POINT = " + ".join(f"(CAST({v} AS FLOAT) - {c}) * (CAST({v} AS FLOAT) - {c})" for v, c in zip(QUERY, XYZ, strict=True))


@_query(f"WITH e AS ({EMB}) SELECT pid, round(CAST({_POINT} AS DOUBLE), 6) AS d2 FROM e WHERE {_POINT} <= {_r2(0.15)}")
def radius_query(spark, sf):
    return search.radius_query(tables.from_embeddings(spark, sf), QUERY, 0.15).select("pid", F.round(F.col("d2").cast("double"), 6).alias("d2"))


@_query(f"WITH e AS ({EMB}) SELECT pid, round(CAST({_POINT} AS DOUBLE), 6) AS d2 FROM e WHERE {_POINT} <= {_r2(0.5)} ORDER BY {_POINT}, pid LIMIT 10")
def radius_query_topk(spark, sf):
    return search.radius_query(tables.from_embeddings(spark, sf), QUERY, 0.5, 10).select("pid", F.round(F.col("d2").cast("double"), 6).alias("d2"))


@_query(f"WITH e AS ({EMB}), n AS ({_pairs(RADIUS)}) SELECT qid, pid, round(CAST(d2 AS DOUBLE), 6) AS d2 FROM n")
def radius_join(spark, sf):
    e = tables.from_embeddings(spark, sf)
    return search.radius_join(e, e, RADIUS).select("qid", "pid", F.round(F.col("d2").cast("double"), 6).alias("d2"))


@_query(f"WITH e AS ({EMB}), n AS ({_pairs(RADIUS)}) SELECT qid, count(*) AS n FROM n GROUP BY qid")
def batch_radius_counts(spark, sf):
    e = tables.from_embeddings(spark, sf)
    return search.radius_join(e, e, RADIUS).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


_KNN = "SELECT q.pid AS qid, CAST(row_number() OVER (PARTITION BY q.pid ORDER BY {d}, p.pid) AS INT) AS rank, p.pid AS pid, {d} AS d2, p.x AS x, p.y AS y, p.z AS z FROM {src} q JOIN {src} p ON q.pid <> p.pid"


@_query(f"WITH c AS ({PART}), n AS ({_KNN.format(d=_d2(), src='c')}) SELECT qid, rank, pid FROM n WHERE rank <= 5")
def knn_join(spark, sf):
    return search.knn_join(tables.from_parts(spark, sf), 5).select("qid", "rank", "pid")


def _lanes(bits: int, order: tuple[int, int, int]) -> str:
    top = (1 << bits) - 1
    q = {c: f"CAST(least(greatest(floor((CAST({c} AS DOUBLE) - CAST(lo_{c} AS DOUBLE)) / extent * {top}.0), 0), {top}) AS BIGINT)" for c in XYZ}
    return " + ".join(f"((({q[c]} >> {i}) & 1) << {3 * i + o})" for c, o in zip(XYZ, order, strict=True) for i in range(bits))


_BOX = "SELECT *, min(x) OVER () AS lo_x, min(y) OVER () AS lo_y, min(z) OVER () AS lo_z, greatest(max(x::DOUBLE) OVER () - min(x::DOUBLE) OVER (), max(y::DOUBLE) OVER () - min(y::DOUBLE) OVER (), max(z::DOUBLE) OVER () - min(z::DOUBLE) OVER ()) AS extent FROM e"


@_query(f"WITH e AS ({EMB}), b AS ({_BOX}) SELECT pid, {_lanes(10, (0, 1, 2))} AS morton, {_lanes(21, (2, 1, 0))} AS morton63 FROM b")
def morton_code(spark, sf):
    e = tables.from_embeddings(spark, sf)
    box = stats.bounding_box(e).select(*(F.col(f"min_{c}").alias(f"_{c}") for c in XYZ), F.greatest(*(F.col(f"max_{c}").cast("double") - F.col(f"min_{c}").cast("double") for c in XYZ)).alias("_e"))
    rows = search.with_morton(e).join(F.broadcast(box))  # one row
    return rows.select("pid", "morton", morton63(*xyz(), tuple(F.col(f"_{c}") for c in XYZ), F.col("_e")).alias("morton63"))


@_query(f"""WITH e AS ({EMB}), b AS ({_BOX}), m AS (SELECT pid, x, y, z, {_lanes(10, (0, 1, 2))} AS morton FROM b), k AS (SELECT *, row_number() OVER (ORDER BY morton, pid) AS rk FROM m)
SELECT q.pid AS qid, p.pid AS pid FROM k q JOIN k p ON abs(q.rk - p.rk) <= 128 WHERE {_d2()} <= {_r2(RADIUS)}""")
def approx_morton_join(spark, sf):
    return search.approx_morton_join(tables.from_embeddings(spark, sf), RADIUS, 128).select("qid", "pid")


# -- filters -----------------------------------------------------------------------------------------------------------


def _sor(value: str, r: float | None, k: int = 10) -> str:
    near = f"SELECT * FROM ({_KNN.format(d=_d2(), src='e')}) t WHERE rank <= {k}" + (f" AND d2 <= {_r2(r)}" if r else "")
    lone = f", {r if value.startswith('sqrt') else r * r}" if r else ", NULL"
    return f"WITH e AS ({EMB}), n AS ({near}), m AS (SELECT e.pid, coalesce(avg({value}){lone}) AS mean FROM e LEFT JOIN n ON n.qid = e.pid GROUP BY e.pid), s AS (SELECT avg(mean) + 1.0 * stddev_pop(mean) AS lim FROM m) SELECT pid FROM m, s WHERE mean <= lim"


@_query(_sor("sqrt(CAST(d2 AS DOUBLE))", None))
def sor_exact(spark, sf):
    return filters.outlier_removal(tables.from_embeddings(spark, sf), 10, 1.0).select("pid")


@_query(_sor("sqrt(CAST(d2 AS DOUBLE))", RADIUS))
def sor_radius(spark, sf):
    return filters.outlier_removal(tables.from_embeddings(spark, sf), 10, 1.0, RADIUS).select("pid")


@_query(_sor("CAST(d2 AS DOUBLE)", RADIUS))
def sor_squared(spark, sf):
    return filters.outlier_removal(tables.from_embeddings(spark, sf), 10, 1.0, RADIUS, squared=True).select("pid")


@_query(f"WITH e AS ({EMB}), n AS ({_pairs(TOL)}) SELECT qid AS pid FROM n GROUP BY qid HAVING count(*) >= 3")
def radius_count_filter(spark, sf):
    return filters.radius_count_filter(tables.from_embeddings(spark, sf), TOL, 3).select("pid")


@_query(f"WITH a AS ({_sor('sqrt(CAST(d2 AS DOUBLE))', RADIUS)}), b AS (WITH e AS ({EMB}), n AS ({_pairs(TOL)}) SELECT qid AS pid FROM n GROUP BY qid HAVING count(*) >= 3) SELECT count(*) AS n, count(a.pid) AS kept_a, count(b.pid) AS kept_b, count(*) FILTER ((a.pid IS NULL) = (b.pid IS NULL)) AS same FROM ({EMB}) e LEFT JOIN a ON a.pid = e.pid LEFT JOIN b ON b.pid = e.pid")
def filter_agreement(spark, sf):
    e = tables.from_embeddings(spark, sf)
    return filters.agreement(e, filters.outlier_removal(e, 10, 1.0, RADIUS), filters.radius_count_filter(e, TOL, 3))


_CELLS = f"SELECT *, CAST(floor((CAST(x AS DOUBLE) - CAST(min(x) OVER (PARTITION BY frame) AS DOUBLE)) / 10.0) AS INT) AS col, CAST(floor((CAST(y AS DOUBLE) - CAST(min(y) OVER (PARTITION BY frame) AS DOUBLE)) / 10.0) AS INT) AS row FROM ({EVT}) t"
_SPLIT = f"SELECT *, z <= min(z) OVER w + CAST(20.0 AS FLOAT) AS is_ground, count(*) OVER w AS n FROM ({_CELLS}) c WINDOW w AS (PARTITION BY frame, row, col)"


def _celled(spark, sf):
    return filters.elevation_cells(tables.from_events(spark, sf), 10.0, ["frame"])


@_query(f"SELECT CAST(frame AS VARCHAR) AS frame, row, col, min(z) AS min_z, max(z) AS max_z, count(*) AS n FROM ({_CELLS}) c GROUP BY frame, row, col")
def grid25_stats(spark, sf):
    return filters.cell_stats(_celled(spark, sf), ["frame"]).withColumn("frame", F.col("frame").cast("string"))


@_query(f"SELECT pid FROM ({_SPLIT}) s WHERE n >= 2")
def density_filter(spark, sf):
    return filters.density_filter(_celled(spark, sf), 2, ["frame"]).select("pid")


@_query(f"SELECT pid, is_ground FROM ({_SPLIT}) s WHERE n >= 2")
def ground_split(spark, sf):
    return filters.ground_split(_celled(spark, sf), 20.0, ["frame"]).select("pid", "is_ground")


@_query(f"SELECT pid FROM ({_SPLIT}) s WHERE NOT is_ground")
def obstacle_set(spark, sf):
    return filters.ground_split(_celled(spark, sf), 20.0, ["frame"], drop_singletons=False).where("NOT is_ground").select("pid")


@_query(f"SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c, round(-coalesce(avg(CAST(z AS DOUBLE)), -1.7), 6) AS d FROM ({_SPLIT}) s WHERE n >= 2 AND is_ground")
def ground_plane(spark, sf):
    g = filters.ground_plane(filters.ground_split(_celled(spark, sf), 20.0, ["frame"]))
    return g.select("a", "b", "c", F.round("d", 6).alias("d"))


# -- planes ------------------------------------------------------------------------------------------------------------

_M, _I, _MOD = plane.MULTIPLIER, plane.INCREMENT, plane.MODULUS
_T, _THR, _SEED = PLANE["iterations"], PLANE["threshold"], PLANE["seed"]
_RANSAC = f"""WITH e AS ({EMB}), k AS (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS rk, count(*) OVER () AS n FROM e),
u AS (SELECT t, j, ((v * v * {_M} + v * {_I} + {_SEED}) % {_MOD}) % (SELECT max(n) FROM k) AS rk FROM (SELECT t, j, 3 * t + j + 1 AS v FROM range({_T}) a(t), range(3) b(j)) d),
s AS (SELECT t, count(DISTINCT rk) AS kinds, {", ".join(f"max(CASE WHEN j = {j} THEN CAST({c} AS DOUBLE) END) AS {c}{j}" for j in range(3) for c in XYZ)} FROM u JOIN k USING (rk) GROUP BY t),
x AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM s WHERE kinds = 3),
m AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS norm FROM x),
planes AS (SELECT t, nx / norm AS a, ny / norm AS b, nz / norm AS c, -(nx / norm * x0 + ny / norm * y0 + nz / norm * z0) AS d FROM m WHERE norm >= 1e-6),
scores AS (SELECT t, CAST(sum(CASE WHEN abs(a * CAST(x AS DOUBLE) + b * CAST(y AS DOUBLE) + c * CAST(z AS DOUBLE) + d) <= {_THR} THEN 1 ELSE 0 END) AS BIGINT) AS inliers FROM e, planes GROUP BY t)"""
_EXECUTED = f"""{_RANSAC},
every AS (SELECT r.t, coalesce(inliers, 0) AS inliers, (SELECT count(*) FROM e) AS n FROM range({_T}) r(t) LEFT JOIN scores USING (t)),
recs AS (SELECT *, inliers > coalesce(max(inliers) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rec,
  least(greatest(1 - (inliers / n::DOUBLE) * (inliers / n::DOUBLE) * (inliers / n::DOUBLE), {plane.EPSILON}), 1 - {plane.EPSILON}) AS miss FROM every),
needs AS (SELECT *, CASE WHEN rec AND abs(ln(miss)) > 1e-7 AND ceil(ln(1 - 0.99) / ln(miss)) > 0 THEN CAST(ceil(ln(1 - 0.99) / ln(miss)) AS BIGINT) END AS need FROM recs),
caps AS (SELECT *, least({_T}, coalesce(min(need) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {_T})) AS cap FROM needs),
ran AS (SELECT * FROM caps WHERE t < cap),
best AS (SELECT t, inliers, (SELECT count(*) FROM ran) AS executed FROM ran ORDER BY inliers DESC, t LIMIT 1)"""


@_query(f"{_RANSAC} SELECT t, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d FROM planes")
def plane_candidates(spark, sf):
    p = plane.candidates(tables.from_embeddings(spark, sf), _T, _SEED).where("a IS NOT NULL")
    return p.select("t", *(F.round(c, 6).alias(c) for c in "abcd"))


@_query(f"{_RANSAC} SELECT t, inliers FROM scores")
def plane_scores(spark, sf):
    e = tables.from_embeddings(spark, sf)
    return plane.scores(e, plane.candidates(e, _T, _SEED), _THR)


@_query(f"{_EXECUTED} SELECT t, inliers, executed, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d FROM best JOIN planes USING (t)")
def ransac_plane(spark, sf):
    p = plane.fit_plane(tables.from_embeddings(spark, sf), _THR, _T, _SEED)
    return p.select("t", "inliers", "executed", *(F.round(c, 6).alias(c) for c in "abcd"))


@_query(f"""{_RANSAC}, f AS (SELECT * FROM e ORDER BY pid LIMIT 64), g AS (SELECT t, sum(CASE WHEN abs(a * CAST(x AS DOUBLE) + b * CAST(y AS DOUBLE) + c * CAST(z AS DOUBLE) + d) <= {_THR} THEN 1 ELSE 0 END) AS k FROM f, planes GROUP BY t),
h AS (SELECT s.* FROM scores s JOIN g USING (t) WHERE t <= 10 OR k >= 0.15 * (SELECT count(*) FROM f)) SELECT t, inliers, (SELECT count(*) FROM h) AS executed FROM h ORDER BY inliers DESC, t LIMIT 1""")
def ransac_pretest(spark, sf):
    return plane.fit_plane(tables.from_embeddings(spark, sf), _THR, _T, _SEED, test_first=True).select("t", "inliers", "executed")


_NEAR = f"abs(a * CAST(x AS DOUBLE) + b * CAST(y AS DOUBLE) + c * CAST(z AS DOUBLE) + d) <= {_THR}"


def _parts(spark, sf):
    e = tables.from_embeddings(spark, sf)
    return plane.split(e, plane.fit_plane(e, _THR, _T, _SEED), _THR)


@_query(f"{_EXECUTED} SELECT pid FROM e, best JOIN planes USING (t) WHERE {_NEAR}")
def plane_inliers(spark, sf):
    return _parts(spark, sf).where("is_inlier").select("pid")


@_query(f"{_EXECUTED} SELECT pid FROM e, best JOIN planes USING (t) WHERE NOT ({_NEAR})")
def plane_outliers(spark, sf):
    return _parts(spark, sf).where("NOT is_inlier").select("pid")


# -- features ----------------------------------------------------------------------------------------------------------

_TERMS = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
_COV = "SELECT qid AS pid, count(*) AS n, " + ", ".join(f"covar_pop({a}::DOUBLE, {b}::DOUBLE) AS {a}{b}" for a, b in _TERMS) + " FROM n GROUP BY qid"


@_query(f"WITH e AS ({EMB}), n AS ({_pairs(RADIUS)}), c AS ({_COV}) SELECT pid, n, " + ", ".join(f"round({a}{b}, 9) + 0.0 AS {a}{b}" for a, b in _TERMS) + " FROM c")
def covariance(spark, sf):
    e = tables.from_embeddings(spark, sf)
    return features.covariance(search.radius_join(e, e, RADIUS)).select("pid", "n", *((F.round(a + b, 9) + 0.0).alias(a + b) for a, b in _TERMS))


def _eigen(pairs: str) -> str:
    """Normals from neighbour pairs n over the cloud e, as CTEs; the last is called o."""
    return f"""WITH e AS ({EMB}), n AS ({pairs}), c AS ({_COV}), m AS (SELECT *, (xx + yy + zz) / 3 AS mu FROM c),
p AS (SELECT *, ((xx - mu) * (xx - mu) + (yy - mu) * (yy - mu) + (zz - mu) * (zz - mu) + 2 * (xy * xy + xz * xz + yz * yz)) / 6 AS p,
  ((xx - mu) * ((yy - mu) * (zz - mu) - yz * yz) - xy * (xy * (zz - mu) - yz * xz) + xz * (xy * yz - (yy - mu) * xz)) / 2 AS q FROM m),
l AS (SELECT *, mu + 2 * sqrt(p) * cos(acos(CASE WHEN p > 0 THEN greatest(least(q / (p * sqrt(p)), 1.0), -1.0) ELSE 1.0 END) / 3 + 2.0943951023931953) AS low FROM p),
r AS (SELECT *, xy * yz - xz * (yy - low) AS ax, xz * xy - (xx - low) * yz AS ay, (xx - low) * (yy - low) - xy * xy AS az,
  xy * (zz - low) - xz * yz AS bx, xz * xz - (xx - low) * (zz - low) AS by_, (xx - low) * yz - xy * xz AS bz,
  (yy - low) * (zz - low) - yz * yz AS cx, yz * xz - xy * (zz - low) AS cy, xy * yz - (yy - low) * xz AS cz FROM l),
s AS (SELECT *, ax * ax + ay * ay + az * az AS sa, bx * bx + by_ * by_ + bz * bz AS sb, cx * cx + cy * cy + cz * cz AS sc FROM r),
v AS (SELECT *, greatest(sa, sb, sc) AS best FROM s),
w AS (SELECT v.*, CASE WHEN sa = best THEN ax WHEN sb = best THEN bx ELSE cx END / sqrt(best) AS ux, CASE WHEN sa = best THEN ay WHEN sb = best THEN by_ ELSE cy END / sqrt(best) AS uy,
  CASE WHEN sa = best THEN az WHEN sb = best THEN bz ELSE cz END / sqrt(best) AS uz FROM v WHERE best > 0 AND n >= 3),
o AS (SELECT e.pid, w.pid IS NOT NULL AS valid, CASE WHEN -e.x * ux - e.y * uy - e.z * uz < 0 THEN -1 ELSE 1 END AS sg, ux, uy, uz, low / (xx + yy + zz) AS curvature FROM e LEFT JOIN w USING (pid))"""


def _flat(c: str) -> str:
    return f"round(coalesce(sg * u{c}, 0), 3) + 0.0 AS n{c}"


def _normals(n: DataFrame) -> DataFrame:
    return n.select("pid", *((F.round(f"n{c}", 3) + 0.0).alias(f"n{c}") for c in XYZ), "valid")


@_query(f"{_eigen(_pairs(0.15))} SELECT pid, {', '.join(map(_flat, XYZ))}, valid FROM o")
def normals_radius(spark, sf):
    return _normals(features.normals_radius(tables.from_embeddings(spark, sf), 0.15))


_KNN_OWN = f"SELECT qid, x, y, z FROM ({_KNN.format(d=_d2(), src='e')}) t WHERE rank <= 12 UNION ALL SELECT pid, x, y, z FROM e"


@_query(f"{_eigen(_KNN_OWN)} SELECT pid, {', '.join(map(_flat, XYZ))}, valid FROM o")
def normals_knn(spark, sf):
    return _normals(features.normals_knn(tables.from_embeddings(spark, sf), 12))


@_query(f"{_eigen(_pairs(0.15))} SELECT pid, round(coalesce(curvature, 0), 5) + 0.0 AS curvature FROM o")
def curvature(spark, sf):
    n = features.normals_radius(tables.from_embeddings(spark, sf), 0.15)
    return n.select("pid", (F.round("curvature", 5) + 0.0).alias("curvature"))


# -- clusters ----------------------------------------------------------------------------------------------------------


def _closure(nodes: str, edges: str) -> str:
    """CTEs: g (node, label) with the least node that each one reaches. nodes and edges (u, v, both ways) are CTE names."""
    return f"reach AS (SELECT node AS node, node AS label FROM {nodes} UNION SELECT k.v AS node, r.label FROM reach r JOIN {edges} k ON k.u = r.node WHERE r.label < k.v), g AS (SELECT node, min(label) AS label FROM reach GROUP BY node)"


_EUCLID = f"WITH RECURSIVE e AS ({EMB}), n AS ({_pairs(TOL)}), nodes AS (SELECT pid AS node FROM e), k AS (SELECT qid AS u, pid AS v FROM n), {_closure('nodes', 'k')}, c AS (SELECT node AS pid, label AS cluster_id, count(*) OVER (PARTITION BY label) AS size FROM g)"


@_query(f"{_EUCLID} SELECT pid, cluster_id, size FROM c")
def euclidean_clusters(spark, sf):
    return cluster.euclidean_clusters(tables.from_embeddings(spark, sf), TOL).select("pid", "cluster_id", "size")


_SIZES = f"{_EUCLID}, s AS (SELECT cluster_id, count(*) AS size, row_number() OVER (ORDER BY cluster_id) - 1 AS ordinal FROM c WHERE size >= 3 GROUP BY cluster_id)"


def _sizes(spark, sf):
    return cluster.cluster_sizes(cluster.euclidean_clusters(tables.from_embeddings(spark, sf), TOL, 3))


@_query(f"{_SIZES} SELECT cluster_id, size, ordinal FROM s")
def cluster_sizes(spark, sf):
    return _sizes(spark, sf)


@_query(f"{_EUCLID} SELECT cluster_id, pid // 4096 AS chunk, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pid) AS pids FROM c WHERE size BETWEEN 3 AND 100000 GROUP BY 1, 2")
def cluster_lists(spark, sf):
    lists = cluster.cluster_lists(cluster.euclidean_clusters(tables.from_embeddings(spark, sf), TOL, 3, 100_000))
    return lists.select("cluster_id", "chunk", F.array_join("pids", ",").alias("pids"))


@_query(f"""{_SIZES}, h AS (SELECT cluster_id, ordinal, 0.35 + (ordinal + 1) * 0.618034::DOUBLE AS t FROM s), i AS (SELECT *, (t - floor(t)) * 6 AS h6 FROM h), j AS (SELECT *, CAST(floor(h6) AS INT) AS k, h6 - floor(h6) AS f FROM i),
q AS (SELECT *, 0.95::DOUBLE AS v, 0.95::DOUBLE * (1 - 0.85::DOUBLE) AS p, 0.95::DOUBLE * (1 - 0.85::DOUBLE * f) AS q, 0.95::DOUBLE * (1 - 0.85::DOUBLE * (1 - f)) AS t2 FROM j)
SELECT cluster_id, ordinal, CAST(floor(255 * CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t2 ELSE v END) AS INT) AS r,
CAST(floor(255 * CASE k WHEN 0 THEN t2 WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END) AS INT) AS g, CAST(floor(255 * CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t2 WHEN 3 THEN v WHEN 4 THEN v ELSE q END) AS INT) AS b FROM q""")
def cluster_colors(spark, sf):
    return cluster.colors(_sizes(spark, sf))


def _cells(keys: dict[str, str], src: str) -> str:
    names = list(keys)
    near = " AND ".join(f"abs(a.{n} - b.{n}) <= 1" for n in names)
    return f"WITH RECURSIVE e AS ({src}), w AS (SELECT pid, {', '.join(f'{e} AS {n}' for n, e in keys.items())} FROM e), nodes AS (SELECT {', '.join(names)}, min(pid) AS node FROM w GROUP BY {', '.join(names)}), k AS (SELECT a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON {near} AND a.node <> b.node), {_closure('nodes', 'k')} SELECT w.pid, g.label AS cluster_id, count(*) OVER (PARTITION BY g.label) AS size FROM w JOIN nodes USING ({', '.join(names)}) JOIN g USING (node)"


@_query(_cells({f"v{c}": _vox(c, 0.05) for c in XYZ}, EMB))
def voxel26_clusters(spark, sf):
    return cluster.voxel_clusters(tables.from_embeddings(spark, sf), 0.05).select("pid", "cluster_id", "size")


@_query(_cells({"vx": _vox("x", 0.02), "vy": _vox("y", 0.02)}, EMB))
def grid8_clusters(spark, sf):
    return cluster.grid_clusters(tables.from_embeddings(spark, sf), 0.02).select("pid", "cluster_id", "size")


@_query(f"SELECT i % 7 AS run, 'system.cpu.l' || (i % 2 + 1) || '.hits' AS name, CAST(i AS DOUBLE) AS value FROM range(14) t(i)")
def simulator_stats(spark, sf):
    i = F.col("id")
    lines = spark.range(14).select((i % 7).alias("run"), F.concat(F.lit("system.cpu.l"), (i % 2 + 1).cast("string"), F.lit(".hits   "), i.cast("string"), F.lit("  # hits")).alias("value"))
    return simstats.parse(lines, ["run"])


# -- pipelines, frames and metrics -------------------------------------------------------------------------------------

CONFIG_3D = Config3D(leaf=0.02, sor_k=10, sor_radius=RADIUS, normal_radius=0.15, plane_threshold=0.05, plane_iterations=PLANE["iterations"], plane_seed=PLANE["seed"], tolerance=0.08, min_cluster=3)
CONFIG_25D = Config25D(leaf=0.02, cell=0.1, ground_height=0.1, tolerance=0.08, min_cluster=3)
_DOWN = f"SELECT min(pid) AS pid, CAST(avg(x) AS FLOAT) AS x, CAST(avg(y) AS FLOAT) AS y, CAST(avg(z) AS FLOAT) AS z FROM ({EMB}) t GROUP BY {_vox('x', 0.02)}, {_vox('y', 0.02)}, {_vox('z', 0.02)}"


_KEPT = f"SELECT d.* FROM ({_DOWN}) d JOIN ({_sor('sqrt(CAST(d2 AS DOUBLE))', RADIUS).replace(EMB, _DOWN)}) s USING (pid)"
_BEST = _EXECUTED.replace(EMB, _KEPT)
_REST = f"{_BEST} SELECT pid, x, y, z FROM e, best JOIN planes USING (t) WHERE NOT ({_NEAR})"
_CLUSTERED = f"WITH RECURSIVE e AS ({_REST}), n AS ({_pairs(0.08)}), nodes AS (SELECT pid AS node FROM e), k AS (SELECT qid AS u, pid AS v FROM n), {_closure('nodes', 'k')}, c AS (SELECT node AS pid, label AS cluster_id, count(*) OVER (PARTITION BY label) AS size FROM g)"


@_query(f"{_CLUSTERED} SELECT pid, cluster_id, size FROM c WHERE size >= 3")
def pipeline_3d_clusters(spark, sf):
    return pipeline_3d(tables.from_embeddings(spark, sf), CONFIG_3D)["06_clusters"].select("pid", "cluster_id", "size")


@_query(f"""SELECT 0 AS "index", '00_input' AS label, (SELECT count(*) FROM embeddings) AS point_count UNION ALL SELECT 1, '01_downsampled', (SELECT count(*) FROM ({_DOWN}) t) UNION ALL SELECT 2, '02_sor_filtered', (SELECT count(*) FROM ({_KEPT}) t)
UNION ALL SELECT 3, '03_normals', (SELECT count(*) FROM ({_KEPT}) t) UNION ALL SELECT 4, '04_ransac_inliers', (SELECT count(*) FROM ({_BEST} SELECT pid FROM e, best JOIN planes USING (t) WHERE {_NEAR}) t)
UNION ALL SELECT 5, '05_ground_plane_removed', (SELECT count(*) FROM ({_REST}) t) UNION ALL SELECT 6, '06_clusters', (SELECT count(*) FROM ({_CLUSTERED} SELECT pid FROM c WHERE size >= 3) t)""")
def pipeline_3d_stages(spark, sf):
    return stage_counts(pipeline_3d(tables.from_embeddings(spark, sf), CONFIG_3D))


@_query(f"""WITH RECURSIVE d AS ({_DOWN}), cl AS (SELECT *, CAST(floor((CAST(x AS DOUBLE) - CAST(min(x) OVER () AS DOUBLE)) / 0.1) AS INT) AS col, CAST(floor((CAST(y AS DOUBLE) - CAST(min(y) OVER () AS DOUBLE)) / 0.1) AS INT) AS row FROM d),
sp AS (SELECT *, z <= min(z) OVER (PARTITION BY row, col) + CAST(0.1 AS FLOAT) AS is_ground FROM cl), e AS (SELECT pid, x, y, z FROM sp WHERE NOT is_ground),
w AS (SELECT pid, {_vox("x", 0.08)} AS vx, {_vox("y", 0.08)} AS vy FROM e), nodes AS (SELECT vx, vy, min(pid) AS node FROM w GROUP BY vx, vy),
k AS (SELECT a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND a.node <> b.node), {_closure("nodes", "k")},
o AS (SELECT w.pid, g.label AS cluster_id, count(*) OVER (PARTITION BY g.label) AS size FROM w JOIN nodes USING (vx, vy) JOIN g USING (node)) SELECT pid, cluster_id, size FROM o WHERE size BETWEEN 3 AND 100000""")
def pipeline_25d_clusters(spark, sf):
    return pipeline_25d(tables.from_embeddings(spark, sf), CONFIG_25D)["06_clusters"].select("pid", "cluster_id", "size")


@_query(f"""WITH d AS ({_DOWN}), cl AS (SELECT *, CAST(floor((CAST(x AS DOUBLE) - CAST(min(x) OVER () AS DOUBLE)) / 0.1) AS INT) AS col, CAST(floor((CAST(y AS DOUBLE) - CAST(min(y) OVER () AS DOUBLE)) / 0.1) AS INT) AS row FROM d),
sp AS (SELECT *, z <= min(z) OVER (PARTITION BY row, col) + CAST(0.1 AS FLOAT) AS is_ground, count(*) OVER (PARTITION BY row, col) AS n FROM cl)
SELECT 0 AS "index", '00_input' AS label, (SELECT count(*) FROM embeddings) AS point_count UNION ALL SELECT 1, '01_downsampled', (SELECT count(*) FROM d) UNION ALL SELECT 2, '02_density_filtered', (SELECT count(*) FROM sp WHERE n >= 2)
UNION ALL SELECT 3, '04_ground', (SELECT count(*) FROM sp WHERE n >= 2 AND is_ground) UNION ALL SELECT 4, '05_obstacles', (SELECT count(*) FROM sp WHERE n >= 2 AND NOT is_ground)""")
def pipeline_25d_stages(spark, sf):
    return stage_counts({k: v for k, v in pipeline_25d(tables.from_embeddings(spark, sf), CONFIG_25D).items() if k != "06_clusters"})


@_query("""WITH m AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, event_type AS label, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1, 2)
SELECT run, label, cents / 100.0::DOUBLE AS ms, round(cents * 100.0::DOUBLE / sum(cents) OVER (PARTITION BY run), 6) AS pct, round(sum(cents) OVER (PARTITION BY run) / 100.0::DOUBLE, 2) AS total_ms FROM m""")
def stage_metrics(spark, sf):
    return sinks.with_shares(_run_metrics(spark, sf), "run").select("run", "label", "ms", F.round("pct", 6).alias("pct"), F.round("total_ms", 2).alias("total_ms"))


@_query("""WITH m AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, event_type AS label, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1, 2)
SELECT run, label, cents / 100.0::DOUBLE AS ms FROM m QUALIFY row_number() OVER (PARTITION BY run ORDER BY cents DESC, label) = 1""")
def bottleneck_stage(spark, sf):
    return sinks.bottleneck(_run_metrics(spark, sf), "run")


def _run_metrics(spark, sf):
    """A day as a run, an event type as a stage, hundredths of values as its time."""
    e = tables.read(spark, sf, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return e.groupBy(F.to_date("ts").cast("string").alias("run"), F.col("event_type").alias("label")).agg((cents / F.lit(100.0)).alias("ms"))


@_query(f"""WITH p AS ({EVT}), f AS (SELECT frame, count(*) AS n FROM p GROUP BY frame), k AS (SELECT frame, n, row_number() OVER (ORDER BY frame) - 1 AS i FROM f)
SELECT CAST(frame AS VARCHAR) AS frame_id, '/stage/00_input' AS topic, 1700000000000000000 + i * 100000000 AS log_time_ns, n AS point_count, 12 AS point_stride, n * 12 AS n_bytes FROM k""")
def frame_timeline(spark, sf):
    messages = sinks.timeline(tables.from_events(spark, sf).withColumn("stage", F.lit("00_input")), fps=10.0, base_ns=1_700_000_000_000_000_000)
    return messages.select("frame_id", "topic", "log_time_ns", "point_count", "point_stride", F.length("data").cast("long").alias("n_bytes"))


# -- layouts, formats, variants ----------------------------------------------------------------------------------------


@_query(f"WITH e AS ({EMB}), b AS ({_BOX}), m AS (SELECT pid, {_lanes(10, (0, 1, 2))} AS morton FROM b) SELECT pid, row_number() OVER (ORDER BY morton, pid) - 1 AS rk FROM m")
def zorder_rank(spark, sf):
    coded = search.morton_sorted(tables.from_embeddings(spark, sf))
    return stats.global_rank(coded, ["morton", "pid"], F.shiftright("morton", 18)).select("pid", "rk")


@_query(f"WITH e AS ({EMB}), b AS (SELECT max(x)::DOUBLE - min(x)::DOUBLE AS ex, max(y)::DOUBLE - min(y)::DOUBLE AS ey, max(z)::DOUBLE - min(z)::DOUBLE AS ez FROM e) SELECT round(greatest(0.001, least(pow(ex * ey * ez / 500, 1 / 3.0::DOUBLE), greatest(ex, ey, ez) / 10)), 9) AS leaf FROM b")
def adaptive_leaf(spark, sf):
    return spark.createDataFrame([(round(stats.adaptive_leaf(tables.from_embeddings(spark, sf), 500), 9),)], "leaf double")


_STAGED = "SELECT CAST(ts AS DATE) AS frame, event_type AS stage, event_id AS pid FROM events"


def _staged(spark, sf):
    return tables.read(spark, sf, "events").select(F.to_date("ts").alias("frame"), F.col("event_type").alias("stage"), F.col("event_id").alias("pid"))


@_query(f"WITH s AS ({_STAGED}), f AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS i FROM (SELECT DISTINCT frame FROM s) t) SELECT pid FROM s JOIN f USING (frame) WHERE i >= 2 AND i < 7")
def frame_slice(spark, sf):
    return sinks.frame_slice(_staged(spark, sf), 2, 5).select("pid")


@_query(f"SELECT stage, pid FROM ({_STAGED}) s WHERE (contains(stage, 'c') OR contains(stage, 'view')) AND NOT contains(stage, 'cl')")
def stage_filter(spark, sf):
    return sinks.stages_of(_staged(spark, sf), ("c", "view"), ("cl",)).select("stage", "pid")


@_query(f"SELECT stage, count(DISTINCT frame) AS frames FROM ({_STAGED}) s GROUP BY stage")
def stage_names(spark, sf):
    return sinks.stage_names(_staged(spark, sf))


_HALF = "SELECT event_type AS label, sum(CAST(round(value * 100) AS BIGINT)) / 100.0::DOUBLE AS ms FROM events WHERE event_id % 2 = {k} GROUP BY 1"


@_query(f"WITH a AS ({_HALF.format(k=0)}), b AS ({_HALF.format(k=1)}), j AS (SELECT label, a.ms AS a_ms, b.ms AS b_ms FROM a JOIN b USING (label)), r AS (SELECT coalesce(label, 'TOTAL') AS label, sum(a_ms) AS a_ms, sum(b_ms) AS b_ms FROM j GROUP BY ROLLUP (label)) SELECT label, round(a_ms, 2) AS a_ms, round(b_ms, 2) AS b_ms, round(a_ms / b_ms, 6) AS speedup FROM r")
def run_comparison(spark, sf):
    """Events of even and of odd ids as two runs of the same stages."""
    e = tables.read(spark, sf, "events")
    half = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("label")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(100.0)).alias("ms"))
    return sinks.comparison(half(0), half(1)).select("label", F.round("a_ms", 2).alias("a_ms"), F.round("b_ms", 2).alias("b_ms"), F.round("speedup", 6).alias("speedup"))


@_query("SELECT event_type AS unit, count(*)::DOUBLE AS hits, count(DISTINCT user_id)::DOUBLE AS misses, round(count(*)::DOUBLE / (count(*) + count(DISTINCT user_id)), 9) AS hit_rate FROM events GROUP BY 1")
def hit_rates(spark, sf):
    """Lines of statistics made of the events: an event type as a unit, its events as hits, its users as misses."""
    e = tables.read(spark, sf, "events").groupBy(F.col("event_type").alias("u")).agg(F.count(F.lit(1)).alias("h"), F.count_distinct("user_id").alias("m"))
    line = lambda end, c: F.concat("u", F.lit(f".{end}   "), F.col(c).cast("string"), F.lit("  # count"))
    lines = e.select(F.explode(F.array(line("hits", "h"), line("misses", "m"), F.lit("---------- Begin"))).alias("value"))
    return simstats.rates(simstats.parse(lines), []).withColumn("hit_rate", F.round("hit_rate", 9))


def _through_pcd(cloud: DataFrame, **options: str) -> DataFrame:
    """Writes the cloud as PCD files into the shared folder and reads them back."""
    at = Staging(cloud.sparkSession, "pcd").root
    pcd.register(cloud.sparkSession)
    cloud.write.format("pcd").mode("append").options(**options).save(at)
    return pcd.read_pcd(cloud.sparkSession, at, rgb="r" in cloud.columns)


@_query(f"SELECT x, y, z FROM ({EMB}) t")
def pcd_binary(spark, sf):
    return _through_pcd(tables.from_embeddings(spark, sf), encoding="binary").select(*XYZ)


@_query(f"SELECT x, y, z FROM ({EMB}) t")
def pcd_ascii(spark, sf):
    return _through_pcd(tables.from_embeddings(spark, sf), encoding="ascii").select(*XYZ)


_SHADES = "CAST(pid % 256 AS SMALLINT) AS r, CAST(pid * 7 % 256 AS SMALLINT) AS g, CAST(pid * 13 % 256 AS SMALLINT) AS b"


@_query(f"SELECT x, y, z, {_SHADES} FROM ({PART}) t")
def pcd_colored(spark, sf):
    shaded = tables.from_parts(spark, sf).selectExpr("pid", *XYZ, *(e.strip() for e in _SHADES.split(", ")))
    return _through_pcd(shaded, encoding="binary").select(*XYZ, "r", "g", "b")


@_query(f"{_EXECUTED}, parts AS (SELECT pid, {_NEAR} AS near FROM e, best JOIN planes USING (t)) SELECT count(*) AS n, count(*) AS n_union, 0::BIGINT AS n_both FROM parts")
def inlier_set_operations(spark, sf):
    """Inliers and outliers are disjoint and make up the cloud."""
    e = tables.from_embeddings(spark, sf)
    parts = Staging(spark, "parts").save(_parts(spark, sf).select("pid", "is_inlier"))
    a, b = parts.where("is_inlier").select("pid"), parts.where("NOT is_inlier").select("pid")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(e, "n").join(one(a.union(b).distinct().intersect(e.select("pid")), "n_union")).join(one(a.intersect(b), "n_both"))  # one row each


@_query(f"{_eigen(_pairs(RADIUS))} SELECT pid, valid, round(abs(coalesce(ux, 0)), 3) + 0.0 AS ax, round(abs(coalesce(uy, 0)), 3) + 0.0 AS ay, round(abs(coalesce(uz, 1)), 3) + 0.0 AS az FROM o")
def normals_unflipped(spark, sf):
    n = features.normals_radius(tables.from_embeddings(spark, sf), RADIUS, flip=False, fallback=(0.0, 0.0, 1.0))
    return n.select("pid", "valid", *((F.round(F.abs(f"n{c}"), 3) + 0.0).alias(f"a{c}") for c in XYZ))


CONFIG_TURBO = Config3D(leaf=0.02, outliers="radius_count", min_neighbours=3, sor_radius=RADIUS, normal_radius=0.15, plane_threshold=0.05, plane_iterations=PLANE["iterations"], plane_seed=PLANE["seed"], plane_test_first=True, tolerance=0.08, min_cluster=3)
_FILTERED = f"SELECT d.* FROM ({_DOWN}) d JOIN (WITH e AS ({_DOWN}), n AS ({_pairs(RADIUS)}) SELECT qid AS pid FROM n GROUP BY qid HAVING count(*) >= 3) k USING (pid)"
_TESTED = f"""{_RANSAC.replace(EMB, _FILTERED)}, f AS (SELECT * FROM e ORDER BY pid LIMIT 64), g AS (SELECT t, sum(CASE WHEN abs(a * CAST(x AS DOUBLE) + b * CAST(y AS DOUBLE) + c * CAST(z AS DOUBLE) + d) <= {_THR} THEN 1 ELSE 0 END) AS k FROM f, planes GROUP BY t),
best AS (SELECT s.t FROM scores s JOIN g USING (t) WHERE t <= 10 OR k >= 0.15 * (SELECT count(*) FROM f) ORDER BY inliers DESC, t LIMIT 1)"""


@_query(f"""SELECT '02_sor_filtered' AS label, (SELECT count(*) FROM ({_FILTERED}) t) AS point_count UNION ALL SELECT '04_ransac_inliers', (SELECT count(*) FROM ({_TESTED} SELECT pid FROM e, best JOIN planes USING (t) WHERE {_NEAR}) t)
UNION ALL SELECT '05_ground_plane_removed', (SELECT count(*) FROM ({_TESTED} SELECT pid FROM e, best JOIN planes USING (t) WHERE NOT ({_NEAR})) t)""")
def pipeline_3d_turbo(spark, sf):
    stages = pipeline_3d(tables.from_embeddings(spark, sf), CONFIG_TURBO)
    return stage_counts({k: stages[k] for k in ("02_sor_filtered", "04_ransac_inliers", "05_ground_plane_removed")}).select("label", "point_count")


@_query(f"""WITH d AS ({_DOWN}), cl AS (SELECT *, CAST(floor((CAST(x AS DOUBLE) - CAST(min(x) OVER () AS DOUBLE)) / 0.1) AS INT) AS col, CAST(floor((CAST(y AS DOUBLE) - CAST(min(y) OVER () AS DOUBLE)) / 0.1) AS INT) AS row FROM d),
sp AS (SELECT *, z <= min(z) OVER (PARTITION BY row, col) + CAST(0.1 AS FLOAT) AS is_ground FROM cl)
SELECT '02_density_filtered' AS label, (SELECT count(*) FROM d) AS point_count UNION ALL SELECT '04_ground', (SELECT count(*) FROM sp WHERE is_ground) UNION ALL SELECT '05_obstacles', (SELECT count(*) FROM sp WHERE NOT is_ground)""")
def pipeline_25d_all_cells(spark, sf):
    """The 2.5D pipeline with cells of one point kept."""
    stages = pipeline_25d(tables.from_embeddings(spark, sf), replace(CONFIG_25D, drop_singletons=False))
    return stage_counts({k: stages[k] for k in ("02_density_filtered", "04_ground", "05_obstacles")}).select("label", "point_count")


@_query()
def walkthrough_stages(spark, sf):
    """The walkthrough's floor is random, so SQL cannot express it; tests hold its stages against one another."""
    return stage_counts(walkthrough(tables.from_embeddings(spark, sf)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_q)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
