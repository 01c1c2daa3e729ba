"""Boxes (x1, y1, x2, y2) and points as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, array: Column) -> Box:
        return cls(*(array[i] for i in range(4)))

    @classmethod
    def named(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))


def area(b: Box) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    high = F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return wide * high


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def padded(b: Box, share: float = 0.2) -> Box:
    """Wider by a share of its size on each side."""
    px, py = (b.x2 - b.x1) * share, (b.y2 - b.y1) * share
    return Box(b.x1 - px, b.y1 - py, b.x2 + px, b.y2 + py)


def holds_point(b: Box, x: Column, y: Column) -> Column:
    return x.between(b.x1, b.x2) & y.between(b.y1, b.y2)


def holds_box(outer: Box, inner: Box) -> Column:
    return (inner.x1 >= outer.x1) & (inner.y1 >= outer.y1) & (inner.x2 <= outer.x2) & (inner.y2 <= outer.y2)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def rounded(b: Box) -> Box:
    """Half to even."""
    return Box(*(F.bround(c, 0).cast("bigint") for c in b))


def laser_anchor(xywh: Column) -> tuple[Column, Column]:
    return xywh[0] + xywh[2] / 2, xywh[1] + xywh[3]


def scale_to(height: Column, most: int) -> Column:
    """Factor that brings an image down to ``most`` rows, never up."""
    return F.when(height > most, F.lit(float(most)) / height).otherwise(F.lit(1.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
