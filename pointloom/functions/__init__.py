"""Column expressions over points."""

from .cells import cell, elevation_cell, morton30, morton63, voxel
from .geometry import cluster_color, distance_sq, hsv_to_rgb, plane_distance, plane_from_points, with_smallest_eigen

__all__ = ["cell", "elevation_cell", "morton30", "morton63", "voxel", "cluster_color", "distance_sq", "hsv_to_rgb", "plane_distance", "plane_from_points", "with_smallest_eigen"]
