"""Incremental 2.5D grids and per-frame runs over streams of points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import elevation_cell


def grid_stats(points: DataFrame, size: float, low: tuple[float, float], *, time: str = "ts", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Cell statistics (min_z, max_z, n) of each time window, kept as streaming state; to be written in update mode.

    The three merge on their own, so the state is the aggregate and late points only refine it; a point later than the
    watermark is dropped with its window. ``low`` is the grid's fixed corner, as a stream has no bounding box.
    """
    cells = points.withColumns({"col": elevation_cell(F.col("x"), F.lit(low[0]), size), "row": elevation_cell(F.col("y"), F.lit(low[1]), size)})
    kept = cells.withWatermark(time, late)
    out = kept.groupBy(F.window(time, window).alias("w"), "row", "col").agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("frame_start"), "row", "col", "min_z", "max_z", "n")


def run_frames(points: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch operator (clustering, plane fitting) on each micro-batch, which are not incremental themselves."""
    return points.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
