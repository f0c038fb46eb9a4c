"""PCD point clouds as a Spark data source: ``spark.read.format("pcd").load(path)``.

Rows are (file, pid, x, y, z) and, for files with an ``rgb`` field, can carry r, g, b; pid is the point's place in its
file. Each file is read by one task, through Spark's file system, so any store that Spark reads will do. Modes:
``ascii``, ``binary`` and ``binary_compressed``. Options: ``mode`` (FAILFAST raises for a bad file, PERMISSIVE skips
it), ``rgb`` (true adds r, g, b). Writing takes ``encoding`` (binary or ascii), a file for each partition.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import ship
from .lzf import decompress

XYZ_SCHEMA = "file string, pid bigint, x float, y float, z float"
RGB_SCHEMA = XYZ_SCHEMA + ", r smallint, g smallint, b smallint"
_KINDS = {("F", 4): "<f4", ("F", 8): "<f8", **{(t, n): f"<{t.lower()}{n}" for t in "IU" for n in (1, 2, 4, 8)}}


@dataclass(frozen=True)
class Header:
    fields: tuple[str, ...]
    sizes: tuple[int, ...]
    types: tuple[str, ...]
    counts: tuple[int, ...]
    points: int
    data: str
    end: int  # where the payload starts

    @property
    def stride(self) -> int:
        return sum(s * c for s, c in zip(self.sizes, self.counts, strict=True))

    def field_at(self, name: str) -> int:
        """Place of a field; ValueError if the file lacks it."""
        if name not in self.fields:
            raise ValueError(f"PCD: no field {name}")
        return self.fields.index(name)


def parse_header(raw: bytes) -> Header:
    """Reads the lines up to DATA. Comments and blank lines are skipped, WIDTH counts only where POINTS is missing."""
    found: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in found:
        stop = raw.find(b"\n", at)
        if stop < 0:
            stop = len(raw)
        if at >= len(raw):
            raise ValueError("PCD: no DATA line")
        key, *values = raw[at:stop].decode("ascii", "replace").split() or [""]
        at = stop + 1
        if key and not key.startswith("#"):
            found[key] = values
    try:
        fields = tuple(found.get("FIELDS", ()))
        sizes, types = tuple(map(int, found.get("SIZE", ()))), tuple(found.get("TYPE", ()))
        counts = tuple(map(int, found["COUNT"])) if "COUNT" in found else (1,) * len(fields)
        points = int((found.get("POINTS") or found.get("WIDTH") or ["0"])[0])
        data = found["DATA"][0]
    except (ValueError, IndexError):
        raise ValueError("PCD: bad header") from None
    if not fields or not len(fields) == len(sizes) == len(types) == len(counts):
        raise ValueError("PCD: FIELDS, SIZE, TYPE and COUNT do not fit together")
    if points <= 0:
        raise ValueError("PCD: no points")
    return Header(fields, sizes, types, counts, points, data, at)


def parse(raw: bytes, rgb: bool = False) -> dict[str, np.ndarray]:
    """Columns x, y, z (single precision) and, if wanted and there, r, g, b of a whole file."""
    h = parse_header(raw)
    at = {c: h.field_at(c) for c in ("x", "y", "z")}
    color = h.fields.index("rgb") if rgb and "rgb" in h.fields else None
    if h.data == "ascii":
        out = _ascii(raw[h.end :], h, at, color)
    elif h.data in ("binary", "binary_compressed"):
        out = _binary(raw, h, at, color)
    else:
        raise ValueError(f"PCD: unknown DATA {h.data}")
    if rgb:
        packed = out.pop("rgb", None)
        bits = packed.view(np.uint32) if packed is not None else np.zeros(len(out["x"]), np.uint32)
        out |= {c: (bits >> s & 255).astype(np.int16) for c, s in (("r", 16), ("g", 8), ("b", 0))}
    return out


def _ascii(text: bytes, h: Header, at: dict[str, int], color: int | None) -> dict[str, np.ndarray]:
    """A number for each field and line; lines that are short or not numbers are skipped."""
    want = {**at, **({"rgb": color} if color is not None else {})}
    got: dict[str, list[float]] = {c: [] for c in want}
    for line in text.decode("ascii", "replace").splitlines():
        parts = line.split()
        try:
            values = [float(parts[i]) for i in range(len(h.fields))]
        except (IndexError, ValueError):
            continue
        for c, i in want.items():
            got[c].append(values[i])
    return {c: np.array(v, np.float32) for c, v in got.items()}


def _binary(raw: bytes, h: Header, at: dict[str, int], color: int | None) -> dict[str, np.ndarray]:
    want = {**at, **({"rgb": color} if color is not None else {})}
    for c, i in want.items():
        if h.sizes[i] != 4:
            raise ValueError(f"PCD: {c} has size {h.sizes[i]}")
    body = raw[h.end :]
    if h.data == "binary":
        if len(body) < h.stride * h.points:
            raise ValueError("PCD: payload cut short")
        rows = np.frombuffer(body, np.uint8, h.stride * h.points).reshape(h.points, h.stride)
        starts = np.cumsum([0, *(s * c for s, c in zip(h.sizes, h.counts, strict=True))])
        return {c: np.ascontiguousarray(rows[:, starts[i] : starts[i] + 4]).view("<f4").ravel() for c, i in want.items()}
    if len(body) < 8:
        raise ValueError("PCD: payload cut short")
    packed, size = (int(v) for v in np.frombuffer(body, "<u4", 2))
    if len(body) < 8 + packed or size < h.stride * h.points:
        raise ValueError("PCD: payload cut short")
    plain = decompress(body[8 : 8 + packed], size)
    out, start = {}, 0
    for i, (s, c) in enumerate(zip(h.sizes, h.counts, strict=True)):  # one block a field
        for name, j in want.items():
            if i == j:
                out[name] = np.frombuffer(plain, "<f4", h.points, start)
        start += s * c * h.points
    return out


def header_text(points: int, encoding: str, rgb: bool) -> str:
    n = 4 if rgb else 3
    row = lambda v: " ".join([v] * n)
    names = "x y z rgb" if rgb else "x y z"
    return f"# .PCD v.7 - Point Cloud Data file format\nVERSION .7\nFIELDS {names}\nSIZE {row('4')}\nTYPE {row('F')}\nCOUNT {row('1')}\nWIDTH {points}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {points}\nDATA {encoding}\n"


def pack(x: np.ndarray, y: np.ndarray, z: np.ndarray, rgb: np.ndarray | None = None, encoding: str = "binary") -> bytes:
    """A whole file. Colours are packed as r << 16 | g << 8 | b in the bits of a float."""
    columns = [np.asarray(v, np.float32) for v in (x, y, z)]
    if rgb is not None:
        bits = (rgb[:, 0].astype(np.uint32) << 16) | (rgb[:, 1].astype(np.uint32) << 8) | rgb[:, 2].astype(np.uint32)
        columns.append(bits.astype("<u4").view("<f4"))
    head = header_text(len(columns[0]), encoding, rgb is not None).encode()
    rows = np.stack(columns, axis=1).astype("<f4") if len(columns[0]) else np.zeros((0, len(columns)), "<f4")
    if encoding == "binary":
        return head + rows.tobytes()
    return head + "".join(" ".join(f"{v:.9g}" for v in r) + "\n" for r in rows.tolist()).encode()


def read_pcd(spark: SparkSession, path: str, *, rgb: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """All PCD files under a path or pattern, read through Spark's own file listing; a task for some files each."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(".pcd")).select("path", "content")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _rows(name, content.as_py(), rgb, mode)

    return files.mapInArrow(scan, RGB_SCHEMA if rgb else XYZ_SCHEMA)


def _rows(name: str, raw: bytes, rgb: bool, mode: str) -> Iterator[pa.RecordBatch]:
    try:
        columns = parse(raw, rgb)
    except ValueError as e:
        if mode.upper() == "PERMISSIVE":
            return
        raise ValueError(f"{name}: {e}") from None
    n = len(columns["x"])
    order = ["x", "y", "z", *(["r", "g", "b"] if rgb else [])]
    for a in range(0, n, 100_000):
        part = slice(a, min(a + 100_000, n))
        size = part.stop - part.start
        yield pa.RecordBatch.from_arrays([pa.array([name] * size), pa.array(np.arange(part.start, part.stop)), *(pa.array(columns[c][part]) for c in order)], ["file", "pid", *order])


def with_frame(points: DataFrame) -> DataFrame:
    """Adds frame and stage from paths like .../by_frame/<frame>/<stage>.pcd or .../<frame>/<stage>.pcd."""
    return points.withColumns({"frame": F.regexp_extract("file", r"([^/]+)/[^/]+\.pcd$", 1), "stage": F.regexp_extract("file", r"([^/]+)\.pcd$", 1)})


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PcdDataSource(DataSource):
    """The format "pcd" for paths that the workers see as files (shared or local folders)."""

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        return RGB_SCHEMA if self.options.get("rgb", "false").lower() == "true" else XYZ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, [f.name for f in schema.fields])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.rgb, self.mode = options.get("rgb", "false").lower() == "true", options.get("mode", "FAILFAST")

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(d, n)) for d, _, names in sorted(os.walk(self.path)) for n in sorted(names) if n.lower().endswith(".pcd")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            yield from _rows(partition.path, f.read(), self.rgb, self.mode)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """A file for each partition, under a temporary name until all tasks have ended."""

    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.encoding, self.names = options["path"].removeprefix("file://"), options.get("encoding", "binary"), names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import uuid

        got = list(rows)
        at = {c: np.array([r[c] for r in got], np.float32) for c in ("x", "y", "z")}
        rgb = np.array([[r["r"], r["g"], r["b"]] for r in got]).reshape(-1, 3) if {"r", "g", "b"} <= set(self.names) else None
        if not got:
            return _Written("")
        os.makedirs(self.path, exist_ok=True)
        path = os.path.join(self.path, f"part-{uuid.uuid4().hex}.pcd")
        with open(path + ".tmp", "wb") as f:
            f.write(pack(at["x"], at["y"], at["z"], rgb, self.encoding))
        return _Written(path)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m and m.path:
                os.replace(m.path + ".tmp", m.path)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path + ".tmp"):
                os.remove(m.path + ".tmp")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    ship(spark)
    spark.dataSource.register(PcdDataSource)
