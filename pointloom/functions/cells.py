"""Cells of regular grids, and Z-order codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def voxel(v: Column, leaf: float) -> Column:
    """floor(v * (1 / leaf)), with the reciprocal and the product in single precision."""
    return F.floor(v * F.lit(1.0 / leaf).cast("float")).cast("int")


def cell(v: Column, size: float) -> Column:
    """floor(v / size) in double precision, as bigint: the key of neighbour joins."""
    return F.floor(v.cast("double") / F.lit(float(size))).cast("long")


def elevation_cell(v: Column, low: Column, size: float) -> Column:
    """Row or column of a 2.5D grid that starts at ``low``."""
    return F.floor((v.cast("double") - low.cast("double")) / F.lit(float(size))).cast("int")


def _spread(v: Column, bits: int) -> Column:
    """Puts two zero bits between the low bits of v."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), 3 * i))
    return out


def _quantised(v: Column, low: Column, extent: Column, bits: int) -> Column:
    top = (1 << bits) - 1
    q = F.when(extent > 0, F.floor((v.cast("double") - low.cast("double")) / extent * F.lit(float(top)))).otherwise(0)
    return F.least(F.greatest(q, F.lit(0)), F.lit(top)).cast("long")


def morton30(x: Column, y: Column, z: Column, low: tuple[Column, Column, Column], extent: Column) -> Column:
    """30-bit Z-order code: 10 bits an axis, one scale for all axes, x in the lowest lane."""
    parts = [F.shiftleft(_spread(_quantised(v, o, extent, 10), 10), i) for i, (v, o) in enumerate(zip((x, y, z), low, strict=True))]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def morton63(x: Column, y: Column, z: Column, low: tuple[Column, Column, Column], extent: Column) -> Column:
    """63-bit Z-order code: 21 bits an axis, x in the highest lane."""
    parts = [F.shiftleft(_spread(_quantised(v, o, extent, 21), 21), 2 - i) for i, (v, o) in enumerate(zip((x, y, z), low, strict=True))]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])
