"""The 3D and 2.5D perception pipelines, and their stage tables.

A pipeline returns its stages by name; each is a lazy DataFrame (frame columns, pid, x, y, z and what the stage adds).
The neighbour pairs of the downsampled cloud are joined once, at the largest radius needed, and used for outlier
removal, normals and clustering.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import cluster_sizes, colors, euclidean_clusters, grid_clusters
from ..operators.features import normals_radius
from ..operators.filters import density_filter, elevation_cells, ground_split, outlier_removal, radius_count_filter
from ..operators.plane import fit_plane, split
from ..operators.search import radius_join
from ..operators.stats import downsample
from ..staging import Staging

#: Stage names in order.
STAGES_3D = ("00_input", "01_downsampled", "02_sor_filtered", "03_normals", "04_ransac_inliers", "05_ground_plane_removed", "06_clusters")
STAGES_25D = ("00_input", "01_downsampled", "02_density_filtered", "04_ground", "05_obstacles", "06_clusters")


@dataclass(frozen=True)
class Config3D:
    """Defaults of the 3D pipeline; leaf must be a positive number."""

    leaf: float = 0.01
    skip_sor: bool = False
    outliers: str = "statistical"  # or "radius_count": at least min_neighbours in sor_radius, the point included
    min_neighbours: int = 3
    sor_k: int = 20
    sor_alpha: float = 1.0
    sor_radius: float = 0.25
    normal_radius: float = 0.03
    plane_threshold: float = 0.2
    plane_iterations: int = 1000
    plane_confidence: float = 0.99
    plane_seed: int = 0
    plane_test_first: bool = False  # candidates are tried on a few points ahead of all
    tolerance: float = 0.15
    min_cluster: int = 50
    max_cluster: int = 100_000

    def __post_init__(self) -> None:
        if not 0 < self.leaf < float("inf"):
            raise ValueError("leaf must be finite and positive")
        if self.outliers not in ("statistical", "radius_count"):
            raise ValueError("outliers must be statistical or radius_count")


@dataclass(frozen=True)
class Config25D:
    leaf: float = 0.10
    cell: float = 0.20
    ground_height: float = 0.20
    tolerance: float = 0.15
    min_cluster: int = 50
    max_cluster: int = 100_000
    drop_singletons: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.leaf < float("inf"):
            raise ValueError("leaf must be finite and positive")


def _colored(points: DataFrame, clusters: DataFrame) -> DataFrame:
    shades = colors(cluster_sizes(clusters))
    return points.join(clusters, "pid").join(shades, "cluster_id").select("pid", "x", "y", "z", "cluster_id", "size", "ordinal", "r", "g", "b")


def pipeline_3d(points: DataFrame, config: Config3D | None = None) -> dict[str, DataFrame]:
    """Stages of one cloud. Raises ValueError if no plane is found."""
    c = config or Config3D()
    staging = Staging(points.sparkSession, "pipeline3d")
    out = {"00_input": points.select("pid", "x", "y", "z")}
    out["01_downsampled"] = down = staging.save(downsample(points, c.leaf))
    reach = max(c.normal_radius, c.tolerance, 0 if c.skip_sor else c.sor_radius)
    pairs = staging.save(radius_join(down, down, reach))
    near = lambda r: pairs.where(F.col("d2") <= F.lit(r).cast("float") * F.lit(r).cast("float"))
    if c.skip_sor:
        kept = down
    elif c.outliers == "radius_count":
        kept = staging.save(radius_count_filter(down, c.sor_radius, c.min_neighbours, pairs=near(c.sor_radius)))
    else:
        kept = staging.save(outlier_removal(down, c.sor_k, c.sor_alpha, c.sor_radius, pairs=near(c.sor_radius)))
    out["02_sor_filtered"] = kept
    among = lambda p, cloud: p.join(cloud.select("pid"), "pid", "left_semi").join(cloud.select(F.col("pid").alias("qid")), "qid", "left_semi")
    out["03_normals"] = kept.join(normals_radius(kept, c.normal_radius, pairs=among(near(c.normal_radius), kept)), "pid")
    plane = staging.save(fit_plane(kept, c.plane_threshold, c.plane_iterations, c.plane_seed, c.plane_confidence, c.plane_test_first))
    if plane.isEmpty():
        raise ValueError("no plane found")
    parts = staging.save(split(kept, plane, c.plane_threshold))
    out["04_ransac_inliers"] = parts.where("is_inlier").drop("is_inlier")
    out["05_ground_plane_removed"] = rest = parts.where("NOT is_inlier").drop("is_inlier")
    clusters = euclidean_clusters(rest, c.tolerance, c.min_cluster, c.max_cluster, pairs=among(near(c.tolerance), rest))
    out["06_clusters"] = _colored(rest, staging.save(clusters))
    return out


def pipeline_25d(points: DataFrame, config: Config25D | None = None) -> dict[str, DataFrame]:
    """Voxel grid, elevation grid, density filter, ground split and clusters of obstacle cells."""
    c = config or Config25D()
    staging = Staging(points.sparkSession, "pipeline25d")
    out = {"00_input": points.select("pid", "x", "y", "z")}
    out["01_downsampled"] = down = staging.save(downsample(points, c.leaf))
    celled = staging.save(elevation_cells(down, c.cell))
    xyz = ("pid", "x", "y", "z")
    out["02_density_filtered"] = density_filter(celled).select(*xyz) if c.drop_singletons else down
    parts = staging.save(ground_split(celled, c.ground_height, drop_singletons=c.drop_singletons))
    out["04_ground"] = parts.where("is_ground").select(*xyz)
    out["05_obstacles"] = rest = parts.where("NOT is_ground").select(*xyz)
    out["06_clusters"] = _colored(rest, staging.save(grid_clusters(rest, c.tolerance, c.min_cluster, c.max_cluster)))
    return out


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(index, label, point_count), a row for each stage."""
    out = None
    for i, (label, df) in enumerate(stages.items()):
        row = df.agg(F.count(F.lit(1)).alias("point_count")).select(F.lit(i).alias("index"), F.lit(label).alias("label"), "point_count")
        out = row if out is None else out.unionByName(row)
    return out


def run_timed(spark: SparkSession, stages: dict[str, DataFrame]) -> DataFrame:
    """Runs every stage and measures it: (index, label, ms, point_count, pct)."""
    import time

    rows = []
    for i, (label, df) in enumerate(stages.items()):
        t = time.perf_counter()
        n = df.count()
        rows.append((i, label, (time.perf_counter() - t) * 1000, n))
    total = sum(r[2] for r in rows) or 1.0
    return spark.createDataFrame([(*r, r[2] * 100 / total) for r in rows], "index int, label string, ms double, point_count bigint, pct double")


def walkthrough(points: DataFrame, ground: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
    """A small cloud with a synthetic floor just below it, through voxels, plane removal, outlier removal and normals."""
    box = points.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))), (F.max("pid") + 1).alias("_first"))
    spread = lambda c, s: (F.col(f"min_{c}") + F.rand(s) * (F.col(f"max_{c}") - F.col(f"min_{c}"))).cast("float").alias(c)
    floor = points.sparkSession.range(0, ground, 1, 1).join(F.broadcast(box)).select((F.col("id") + F.col("_first")).alias("pid"), spread("x", seed), spread("y", seed + 1), (F.col("min_z") - 0.005).cast("float").alias("z"))
    staging = Staging(points.sparkSession, "walkthrough")
    out = {"00_input": staging.save(points.select("pid", "x", "y", "z").unionByName(floor))}
    out["01_downsampled"] = down = staging.save(downsample(out["00_input"], 0.01))
    plane = staging.save(fit_plane(down, 0.005, 1000, seed))
    if plane.isEmpty():
        raise ValueError("no plane found")
    rest = staging.save(split(down, plane, 0.005).where("NOT is_inlier").drop("is_inlier"))
    out["04_ground_plane_removed"] = rest
    out["05_sor_filtered"] = kept = staging.save(outlier_removal(rest, 50, 1.0))
    out["06_normals"] = kept.join(normals_radius(kept, 0.03), "pid")
    return out
