"""Box functions over columns: a box is a struct with x0, y0, x1, y1 (top-left origin, points)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> Column:
    """The struct of a row's own x0, y0, x1, y1, or of another's with a prefix such as ``b.``."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def area(b: Column) -> Column:
    """Width times height; 0 for an empty or turned box."""
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """The area that two boxes share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def inside_centre(a: Column, b: Column) -> Column:
    """Whether the centre of a lies in b."""
    x, y = (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2
    return (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])


def share(a: Column, b: Column) -> Column:
    """The part of a that lies in b, from 0 to 1; for a box without area whether its centre does."""
    return F.when(area(a) > 0, overlap(a, b) / area(a)).otherwise(F.when(inside_centre(a, b), F.lit(1.0)).otherwise(F.lit(0.0)))


def distance(a: Column, b: Column) -> Column:
    """Horizontal plus vertical gap between two boxes; 0 where they touch."""
    gap = lambda lo, hi: F.greatest(b[lo] - a[hi], a[lo] - b[hi], F.lit(0.0))
    return gap("x0", "x1") + gap("y0", "y1")


def contains(outer: Column, inner: Column, tolerance: float = 0.0) -> Column:
    """Whether the outer box, grown by the tolerance, holds the inner one."""
    return (inner["x0"] >= outer["x0"] - tolerance) & (inner["y0"] >= outer["y0"] - tolerance) & (inner["x1"] <= outer["x1"] + tolerance) & (inner["y1"] <= outer["y1"] + tolerance)


def union_aggregates() -> list[Column]:
    """Aggregates that give the smallest box around all."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def clip(a: Column, b: Column) -> Column:
    """The part of a inside b, as a box; null if there is none."""
    c = F.struct(*[f(a[k], b[k]).alias(k) for f, k in ((F.greatest, "x0"), (F.greatest, "y0"), (F.least, "x1"), (F.least, "y1"))])
    return F.when((c["x1"] > c["x0"]) & (c["y1"] > c["y0"]), c)
