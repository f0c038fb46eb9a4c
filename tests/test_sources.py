"""PCD files, stage tables, metrics, timeline and streams."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.plans.pipelines import Config3D, run_timed
from pointloom.sources import lzf, pcd, sinks
from pointloom.streaming.frames import grid_stats


def head(data, points, fields="x y z", sizes="4 4 4", types="F F F", counts=None):
    return (f"# c\n\nVERSION .5\nFIELDS {fields}\nSIZE {sizes}\nTYPE {types}\n" + (f"COUNT {counts}\n" if counts else "") + f"WIDTH {points}\nHEIGHT 1\nPOINTS {points}\nDATA {data}\n").encode()


@pytest.fixture
def xyz():
    return np.random.default_rng(1).normal(size=(1000, 3)).astype(np.float32)


def test_binary_keeps_the_bits(spark, tmp_path, xyz):
    (tmp_path / "a.pcd").write_bytes(pcd.pack(*xyz.T))
    rows = pcd.read_pcd(spark, str(tmp_path)).orderBy("pid").collect()
    assert np.array_equal(np.array([(r.x, r.y, r.z) for r in rows], np.float32), xyz)


def test_ascii_skips_bad_lines():
    got = pcd.parse(head("ascii", 4) + b"1 2 3\nbad\n4 5\n4 5 6\n")
    assert got["x"].tolist() == [1, 4] and got["z"].tolist() == [3, 6]


def test_extra_fields_are_projected_away():
    row = struct.pack("<ffffH", 1, 2, 3, 9, 7)
    got = pcd.parse(head("binary", 2, "x y z intensity ring", "4 4 4 4 2", "F F F F U") + row * 2)
    assert [got[c].tolist() for c in "xyz"] == [[1, 1], [2, 2], [3, 3]]


def test_compressed_is_read_field_by_field(xyz):
    plain = xyz.T.astype("<f4").tobytes()
    packed = lzf.literal(plain)
    got = pcd.parse(head("binary_compressed", 1000) + struct.pack("<II", len(packed), len(plain)) + packed)
    assert all(np.array_equal(got[c], xyz[:, i]) for i, c in enumerate("xyz"))


def test_lzf_references():
    assert lzf.decompress(bytes([2]) + b"abc" + bytes([1 << 5, 2]), 6) == b"abcabc"
    assert lzf.decompress(bytes([0]) + b"a" + bytes([7 << 5, 3, 0]), 13) == b"a" * 13
    for bad in (bytes([5]) + b"ab", bytes([1 << 5, 2]), bytes([0]) + b"a" + bytes([7 << 5])):
        with pytest.raises(ValueError):
            lzf.decompress(bad, 6)


def test_colours(xyz):
    rgb = np.arange(3000).reshape(-1, 3) % 256
    got = pcd.parse(pcd.pack(*xyz.T, rgb), rgb=True)
    assert np.array_equal(np.c_[got["r"], got["g"], got["b"]], rgb)


@pytest.mark.parametrize(
    "raw",
    [
        head("binary", 1, "x y", "4 4", "F F") + b"0" * 8,
        head("binary", 1, "x y z", "4 4", "F F F") + b"0" * 12,
        head("binary", 0),
        head("binary", 2) + b"0" * 12,
        head("other", 1),
        head("binary", 1, "x y z", "8 8 8") + b"0" * 24,
        head("binary_compressed", 1) + struct.pack("<II", 3, 12) + b"\x05ab",
        b"FIELDS x y z\n",
    ],
)
def test_bad_files(spark, tmp_path, raw):
    with pytest.raises(ValueError):
        pcd.parse(raw)
    (tmp_path / "bad.pcd").write_bytes(raw)
    (tmp_path / "good.pcd").write_bytes(pcd.pack([1], [2], [3]))
    assert pcd.read_pcd(spark, str(tmp_path), mode="PERMISSIVE").count() == 1


def test_format_round_trip(spark, tmp_path):
    pcd.register(spark)
    df = spark.range(10).select(F.col("id").cast("float").alias("x"), F.lit(1.5).cast("float").alias("y"), F.lit(-2.0).cast("float").alias("z"), *(F.lit(v).cast("smallint").alias(c) for c, v in (("r", 255), ("g", 7), ("b", 0))))
    for encoding in ("binary",):
        out = str(tmp_path / encoding)
        df.write.format("pcd").mode("append").option("encoding", encoding).save(out)
        back = spark.read.format("pcd").option("rgb", "true").load(out)
        assert sorted(r.x for r in back.collect()) == list(range(10))
        assert {(r.y, r.z, r.r, r.g, r.b) for r in back.collect()} == {(1.5, -2.0, 255, 7, 0)}


def test_stage_table(spark, tmp_path):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "pid bigint, x float, y float, z float")
    for frame in ("f1", "f2", "f3"):
        sinks.write_stages({"00_input": p, "06_clusters": p.withColumn("cluster_id", F.lit(0))}, str(tmp_path / "t"), frame)
    t = spark.read.option("mergeSchema", "true").parquet(str(tmp_path / "t"))
    assert t.count() == 6
    assert {r.stage for r in sinks.stages_of(t, include=["06"]).collect()} == {"06_clusters"}
    assert sinks.stages_of(t, include=["0"], exclude=["clusters", "x"]).count() == 3
    assert {r.frame for r in sinks.frame_slice(t, 1, 1).collect()} == {"f2"}


def test_metrics(spark):
    m = run_timed(spark, {"a": spark.range(3), "b": spark.range(5)})
    assert [r.point_count for r in m.orderBy("index").collect()] == [3, 5]
    doc = json.loads(sinks.metrics_json(m, 0.1, False, 0.15).first().value)
    assert [s["label"] for s in doc["stages"]] == ["a", "b"] and doc["leaf_size"] == 0.1
    assert "TOTAL" in {r.label for r in sinks.comparison(m, m).collect()}


def test_packed_floats(spark):
    values = [0.0, 1.0, -1.0, 0.1, 1e-40, 3.4e38, 2.0**-126, 123456.789, -7.25, 1e-45, 16777216.0, float("inf"), float("-inf")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v float").select("i", F.unhex(sinks.little_endian(F.col("v"))).alias("b")).orderBy("i").collect()
    assert [bytes(r.b) for r in rows] == [struct.pack("<f", np.float32(v)) for v in values]


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        Config3D(leaf=0)


def test_streamed_grid_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    shape = lambda d: d.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("float").alias("x"), F.hour("ts").cast("float").alias("y"), F.col("value").cast("float").alias("z"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        events.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = grid_stats(shape(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), 10.0, (0.0, 0.0), late="60 days")
    stream.writeStream.outputMode("update").format("memory").queryName("grid").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    last = spark.table("grid").groupBy("frame_start", "row", "col").agg(F.min("min_z").alias("min_z"), F.max("max_z").alias("max_z"), F.max("n").alias("n"))
    batch = grid_stats(shape(events), 10.0, (0.0, 0.0))
    assert last.exceptAll(batch).count() == 0 and batch.exceptAll(last).count() == 0
