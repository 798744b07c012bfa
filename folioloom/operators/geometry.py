"""Boxes, polylines and shapes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounding_boxes(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")))


def _sides(points: Column, closed: bool) -> Column:
    """Pairs of neighbouring points as structs (a, b)."""
    after = F.slice(points, F.lit(2), F.size(points))
    after = F.concat(after, F.slice(points, F.lit(1), F.lit(1))) if closed else after
    ends = F.filter(F.arrays_zip(points.alias("a"), after.alias("b")), lambda s: s["b"].isNotNull())
    return ends


def path_length(points: Column, closed: bool = False) -> Column:
    """Length of a line through points (structs x, y); closed: back to the first."""
    return F.aggregate(_sides(points, closed), F.lit(0.0), lambda a, s: a + F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def polygon_area(points: Column) -> Column:
    """Area by the shoelace sum, whichever way round."""
    return F.abs(F.aggregate(_sides(points, True), F.lit(0.0), lambda a, s: a + (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]))) / 2


def calibrated(drawn: Column, real: Column, value: Column, square: bool = False) -> Column:
    """``value`` in real units, given that ``drawn`` is ``real`` long; null unless both are above 0."""
    scale = real / drawn
    return F.when((drawn > 0) & (real > 0), value * (scale * scale if square else scale))


def contains(clip: tuple[Column, ...], box: tuple[Column, ...], slack: float = 0.5) -> Column:
    """Whether a clip (x0, y0, x1, y1) holds a box, but for ``slack``."""
    return (clip[0] - slack <= box[0]) & (clip[1] - slack <= box[1]) & (clip[2] + slack >= box[2]) & (clip[3] + slack >= box[3])


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...], grow: float = 0.0) -> Column:
    """Whether two boxes share more than an edge, after one has grown."""
    return (a[0] - grow < b[2]) & (b[0] < a[2] + grow) & (a[1] - grow < b[3]) & (b[1] < a[3] + grow)


def ellipse(x0: Column, y0: Column, x1: Column, y1: Column, n: int = 48) -> Column:
    """``n`` points of the ellipse inside a box."""
    angle = lambda k: 2 * F.pi() * k / n
    point = lambda k: F.struct(((x0 + x1) / 2 + (x1 - x0) / 2 * F.cos(angle(k))).alias("x"), ((y0 + y1) / 2 + (y1 - y0) / 2 * F.sin(angle(k))).alias("y"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def thinned(points: Column, least: float = 0.3) -> Column:
    """Points at least ``least`` from the last one kept; the first stays."""
    far = lambda kept, p: F.hypot(p["x"] - F.element_at(kept, -1)["x"], p["y"] - F.element_at(kept, -1)["y"]) >= least
    return F.aggregate(F.slice(points, F.lit(2), F.size(points)), F.slice(points, F.lit(1), F.lit(1)), lambda kept, p: F.when(far(kept, p), F.concat(kept, F.array(p))).otherwise(kept))
