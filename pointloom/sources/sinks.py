"""Stage tables, metrics, and the message timeline of a frame sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_stages(stages: dict[str, DataFrame], path: str, frame: str) -> None:
    """One Parquet table for all stages, partitioned by frame and stage: readable by either."""
    for name, df in stages.items():
        rows = df.select("pid", "x", "y", "z", *(c for c in ("cluster_id", "r", "g", "b", "nx", "ny", "nz", "curvature", "valid") if c in df.columns))
        rows.withColumns({"frame": F.lit(frame), "stage": F.lit(name)}).write.mode("append").partitionBy("frame", "stage").parquet(path)


def stages_of(table: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows of the stages whose name equals or contains a given one; excluded ones go."""
    name = F.col("stage")
    hit = lambda parts: F.greatest(*(F.contains(name, F.lit(p)) for p in parts)) if len(parts) > 1 else F.contains(name, F.lit(parts[0]))
    out = table.where(hit(include)) if include else table
    return out.where(~hit(exclude)) if exclude else out


def stage_names(table: DataFrame) -> DataFrame:
    """(stage, frames): the stages there are and in how many frames each occurs."""
    return table.groupBy("stage").agg(F.count_distinct("frame").alias("frames"))


def frame_slice(table: DataFrame, start: int = 0, most: int | None = None) -> DataFrame:
    """Rows of the frames from the start-th on, at most ``most`` frames; frames in the order of their names."""
    frames = table.select("frame").distinct().withColumn("_i", F.row_number().over(Window.orderBy("frame")) - 1)
    keep = frames.where(F.col("_i") >= start)
    keep = keep.where(F.col("_i") < start + most) if most is not None else keep
    return table.join(keep.select("frame"), "frame", "left_semi")


def with_shares(metrics: DataFrame, run: str) -> DataFrame:
    """Adds total_ms of the run and each stage's pct."""
    total = metrics.groupBy(run).agg(F.sum("ms").alias("total_ms"))
    return metrics.join(total, run).withColumn("pct", F.col("ms") * 100 / F.col("total_ms"))


def bottleneck(metrics: DataFrame, run: str) -> DataFrame:
    """The slowest stage of each run; of equal ones the first by name."""
    best = metrics.groupBy(run).agg(F.min(F.struct((-F.col("ms")).alias("m"), "label")).alias("b"))
    return best.select(run, F.col("b.label").alias("label"), (-F.col("b.m")).alias("ms"))


def metrics_json(metrics: DataFrame, leaf_size: float, skip_sor: bool, tolerance: float) -> DataFrame:
    """One JSON document of a run: parameters, total and stages in order."""
    stage = F.struct("index", "label", "ms", "pct", "point_count")
    return metrics.agg(F.sum("ms").alias("total_ms"), F.array_sort(F.collect_list(stage)).alias("stages")).select(
        F.to_json(F.struct(F.lit(leaf_size).alias("leaf_size"), F.lit(skip_sor).alias("skip_sor"), F.lit(tolerance).alias("cluster_tolerance"), "total_ms", "stages")).alias("value")
    )


def comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stage by stage: ms of two runs and the speed-up, with a TOTAL row."""
    both = a.select("label", F.col("ms").alias("a_ms")).join(b.select("label", F.col("ms").alias("b_ms")), "label")
    rolled = both.rollup("label").agg(F.sum("a_ms").alias("a_ms"), F.sum("b_ms").alias("b_ms"))
    return rolled.select(F.coalesce("label", F.lit("TOTAL")).alias("label"), "a_ms", "b_ms", F.try_divide("a_ms", "b_ms").alias("speedup"))


def little_endian(v: Column) -> Column:
    """Four bytes of a float. The bits come from its sign, exponent and fraction; not-a-number has the usual pattern."""
    d = v.cast("double")
    size = F.abs(d)
    e = F.greatest(F.floor(F.log2(size)), F.lit(-126))
    e = F.when(F.pow(F.lit(2.0), e) > size, F.greatest(e - 1, F.lit(-126))).when(F.pow(F.lit(2.0), e + 1) <= size, e + 1).otherwise(e)
    fraction = size / F.pow(F.lit(2.0), e)
    usual = ((e + 127) * F.lit(1 << 23) + F.round((fraction - 1) * F.lit(float(1 << 23)))).cast("long")
    small = F.round(size / F.lit(2.0**-149)).cast("long")
    bits = F.when(F.isnan(d), F.lit(0x7FC00000)).when(size == float("inf"), F.lit(0x7F800000)).when(size == 0, F.lit(0)).when(size < 2.0**-126, small).otherwise(usual).cast("long")
    signed = bits + F.when(d < 0, F.lit(1 << 31)).otherwise(F.lit(0)).cast("long")
    h = F.lpad(F.hex(signed), 8, "0")
    return F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))


def timeline(points: DataFrame, fps: float, base_ns: int = 0) -> DataFrame:
    """A message for each frame and stage: (frame_id, stage, topic, log_time_ns, point_count, point_stride, data).

    data packs the frame's points in the order of pid, 12 bytes each (x, y, z) or 15 with r, g, b; a message is one
    frame's stage, which the format wants in one piece. Times step by 1 / fps over the frames in order.
    """
    rgb = {"r", "g", "b"} <= set(points.columns)
    one = F.concat(*(little_endian(F.col(c)) for c in ("x", "y", "z")), *((F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in ("r", "g", "b")) if rgb else ()))
    packed = points.groupBy("frame", "stage").agg(F.count(F.lit(1)).alias("point_count"), F.array_sort(F.collect_list(F.struct("pid", one.alias("p")))).alias("_rows"))
    frames = points.select("frame").distinct().withColumn("_i", (F.row_number().over(Window.orderBy("frame")) - 1).cast("long"))
    step = F.lit(int(round(1e9 / fps))).cast("long")
    return packed.join(frames, "frame").select(
        F.col("frame").cast("string").alias("frame_id"), "stage", F.concat(F.lit("/stage/"), "stage").alias("topic"), (F.lit(base_ns).cast("long") + F.col("_i") * step).alias("log_time_ns"),
        "point_count", F.lit(15 if rgb else 12).alias("point_stride"), F.unhex(F.array_join(F.transform("_rows", lambda r: r["p"]), "")).alias("data"),
    )
