"""What is drawn onto pages: shapes and strokes as points and as content, filled boxes, and moves by a matrix and its inverse.

All are columns over arrays of points (structs x, y) and follow their rows; clouds and the text of paths, which are long, are written by Arrow functions. Nulls give null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import plain_number
from .geometry import ellipse

#: An arrow's head (points, shares of the width) and how far its barbs spread, points of half a bump, and determinants and moves that count as none.
HEAD, HEAD_SHARE, SPREAD, ARC, NONE = 6.0, 3.5, 7, 10, 1e-9


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def shape_points(kind: Column, a: Column, b: Column, width: Column) -> Column:
    """Points of a rect, ellipse, line or arrow between two points; null for other kinds. The head of an arrow grows with the line's width."""
    ax, ay, bx, by = a["x"], a["y"], b["x"], b["y"]
    rect = F.array(point(ax, ay), point(bx, ay), point(bx, by), point(ax, by))
    round_ = ellipse(F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by))
    head, angle = F.greatest(F.lit(HEAD), width * HEAD_SHARE), F.atan2(by - ay, bx - ax)
    barb = lambda turn: point(bx - F.cos(angle + turn) * head, by - F.sin(angle + turn) * head)
    arrow = F.array(point(ax, ay), point(bx, by), barb(F.pi() / SPREAD), point(bx, by), barb(-F.pi() / SPREAD))
    out = F.when(kind == "rect", rect).when(kind == "ellipse", round_).when(kind == "line", F.array(point(ax, ay), point(bx, by))).when(kind == "arrow", arrow)
    return F.when(ax.isNotNull() & ay.isNotNull() & bx.isNotNull() & by.isNotNull(), out)


def is_closed(kind: Column) -> Column:
    return kind.isin("rect", "ellipse", "cloud")


def cloud_points(corners: Column, scallop: Column) -> Column:
    """Bumps of about ``scallop`` (6 at least) along the sides of a polygon, on the side away from the mean of its corners; sides without length have none, and fewer than two corners stay as they are."""
    out = F.arrow_udf(_clouds, "array<struct<x: double, y: double>>")(corners, scallop.cast("double"))
    return F.when(F.size(corners) < 2, corners).otherwise(out)


def _flat(points: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of points: how many each has, all x and y (nan where there is none), and whether each is known."""
    count = np.asarray(pc.list_value_length(points).fill_null(0).to_numpy(zero_copy_only=False), "i8")
    flat = points.flatten()
    x, y = (pc.struct_field(flat, c).cast(pa.float64()) for c in ("x", "y"))
    known = pc.and_(x.is_valid(), y.is_valid()).to_numpy(zero_copy_only=False)
    return count, *(c.fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in (x, y)), known


def _clouds(corners: pa.Array, scallop: pa.Array) -> pa.Array:
    """Sides of all polygons at once, then their bumps, then the points of these."""
    count, x, y, known = _flat(corners)
    n, of = len(count), np.repeat(np.arange(len(count)), count)
    start = np.cumsum(count) - count
    whole = (count >= 2) & (np.bincount(of, ~known, n) == 0)
    wide = np.asarray(scallop.fill_null(3.0).to_numpy(zero_copy_only=False), "f8")
    radius = np.where(wide > 3.0, wide, 3.0)[of] / 2
    after = np.arange(len(x)) + 1
    after = np.where(after == (start + count)[of], start[of], after)
    with np.errstate(all="ignore"):
        mx, my = np.bincount(of, x, n)[of] / count[of], np.bincount(of, y, n)[of] / count[of]
        dx, dy = x[after] - x, y[after] - y
        long = np.hypot(dx, dy)
        side = np.flatnonzero(whole[of] & (long >= 1e-6) & (long < math.inf))
        x, y, bx, by, dx, dy, long, radius, of, mx, my = (c[side] for c in (x, y, x[after], y[after], dx, dy, long, radius, of, mx, my))
        bumps = np.maximum(1, np.floor(long / (radius * 2) + 0.5)).astype("i8")
        step, ux, uy = long / bumps, dx / long, dy / long
        turn = np.where(((x + bx) / 2 - mx) * -uy + ((y + by) / 2 - my) * ux < 0, -1.0, 1.0)
    bump = np.repeat(np.arange(len(side)), bumps)
    j = np.arange(len(bump)) - np.repeat(np.cumsum(bumps) - bumps, bumps)
    angles = [math.pi - t / ARC * math.pi for t in range(ARC + 1)]
    r, out_at = (step / 2)[bump][:, None], (step[bump] * j)[:, None]
    along = out_at + (r + np.array([math.cos(g) for g in angles]) * r)
    away = np.array([math.sin(g) for g in angles]) * r * turn[bump][:, None]
    ux, uy, x, y = (c[bump][:, None] for c in (ux, uy, x, y))
    points = pa.StructArray.from_arrays([pa.array((x + ux * along - uy * away).ravel()), pa.array((y + uy * along + ux * away).ravel())], names=["x", "y"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, bumps, n).astype("i8") * (ARC + 1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~whole, False)), points)


#: What follows the point in a number of so many thousandths.
DECIMALS = pa.array([f".{k:03d}".rstrip("0").rstrip(".") for k in range(1000)])


def _said(x: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Numbers as ``plain_number`` writes them: whole numbers with their sign, and decimals."""
    with np.errstate(all="ignore"):
        n = np.floor(x * 1000 + 0.5)
        n[~np.isfinite(x) | ~np.isfinite(x * 1000)] = 0
    size = np.abs(n)
    near = size < 2**53
    whole = np.floor(np.where(near, size, 0) / 1000)
    rest = np.where(near, size - whole * 1000, 0).astype("i8")
    said, decimals = pa.array(np.copysign(whole, n).astype("i8")).cast(pa.string()), DECIMALS.take(pa.array(rest))
    odd = (n < 0) & ((whole == 0) | ~near) | ~near
    if odd.any():  # a sign before nought, and what is too large for its thousandths
        exact = [divmod(abs(int(v)), 1000) for v in n[odd].tolist()]
        sign = ["-" if v < 0 else "" for v in n[odd].tolist()]
        said = pc.replace_with_mask(said, pa.array(odd), pa.array([f"{s}{w}" for s, (w, _) in zip(sign, exact)]))
        decimals = pc.replace_with_mask(decimals, pa.array(odd), DECIMALS.take(pa.array([r for _, r in exact])))
    return said, decimals


def _paths(points: pa.Array, closed: pa.Array) -> pa.Array:
    """Of each stroke how many points it has, where it begins, and what follows."""
    count, x, y, known = _flat(points)
    n, of = len(count), np.repeat(np.arange(len(count)), count)
    start, shut = np.cumsum(count) - count, closed.fill_null(False).to_numpy(zero_copy_only=False)
    lost = np.bincount(of, ~known, n) > 0
    at = np.arange(len(x)) - start[of]
    says_x, says_y = _said(x), _said(y)
    steps = pc.binary_join_element_wise(*says_x, " ", *says_y, " l ", "")
    first = pc.if_else(pa.array(count > 0), pc.utf8_slice_codeunits(steps.take(pa.array(np.minimum(start, max(len(x) - 1, 0)))), 0, -3) if len(x) else pa.nulls(n, pa.string()), "")
    # inner points of open strokes are met half-way to the next
    curved = ~shut[of] & (at > 0) & (at < count[of] - 1)
    if curved.any():
        inner = np.flatnonzero(curved)
        own = pa.array(inner)
        half = [_said((c[inner] + c[inner + 1]) / 2) for c in (x, y)]
        text = pc.binary_join_element_wise(*(c.take(own) for c in says_x), " ", *(c.take(own) for c in says_y), " ", *half[0], " ", *half[1], " v ", "")
        steps = pc.replace_with_mask(steps, pa.array(curved), text)
    ends = np.concatenate([[0], np.cumsum(np.maximum(count - 1, 0))])
    rest = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps.filter(pa.array(at > 0))), "")
    rest = pc.binary_join_element_wise(rest, pc.if_else(pa.array(shut & (count > 1)), "h ", ""), "")
    known_all, there = pa.array(~lost), points.is_valid()
    none = pa.scalar(None, pa.string())
    fields = [pa.array(count, pa.int32()), pc.if_else(known_all, first, none), pc.if_else(known_all, rest, none)]
    return pa.StructArray.from_arrays(fields, names=["n", "first", "rest"], mask=pc.invert(there))


def _numbers(*values: Column) -> Column:
    return F.concat_ws(" ", *map(plain_number, values))


def stroke(points: Column, width: Column, colour: tuple[Column, Column, Column], closed: Column, state: Column | None = None) -> Column:
    """Content of a stroke with round ends: closed ones through their corners, open ones curved through the middles between points, a lone point a dot. Without points, or with more than one and no width, it is empty.

    ``state``: name of a graphics state to set first, such as one of an opacity.
    """
    # points are met once, so they are made once
    own = F.arrow_udf(_paths, "struct<n:int,first:string,rest:string>")(points, F.coalesce(closed, F.lit(False)))
    n, first = own["n"], own["first"]
    path = F.when((n < 2) | (width <= 0), F.concat(first, F.lit(" l "))).otherwise(own["rest"])
    set_ = F.lit("") if state is None else F.coalesce(F.concat(F.lit("/"), state, F.lit(" gs ")), F.lit(""))
    head = F.concat(F.lit("\nq "), set_, F.lit("1 J 1 j "), plain_number(width), F.lit(" w "), _numbers(*colour), F.lit(" RG "))
    whole = F.concat(head, first, F.lit(" m "), path, F.lit("S Q\n"))
    return F.when((n == 0) | ((n > 1) & (width <= 0)), "").otherwise(whole)


def filled(box: tuple[Column, Column, Column, Column], colour: tuple[Column, Column, Column], state: Column | None = None) -> Column:
    """Content of a filled box (x, y, width, height); empty without an extent."""
    set_ = F.lit("") if state is None else F.coalesce(F.concat(F.lit("/"), state, F.lit(" gs ")), F.lit(""))
    return F.when((box[2] <= 0) | (box[3] <= 0), "").otherwise(F.concat(F.lit("\nq "), set_, _numbers(*colour), F.lit(" rg "), _numbers(*box), F.lit(" re f Q\n")))


def held(clip: Column, box: tuple[Column, ...], dx: Column, dy: Column) -> tuple[Column, Column]:
    """A move kept inside a clip (array x0, y0, x1, y1; null: none): as far as there is room that way, and never the other way."""

    def room(low: Column, high: Column, want: Column) -> Column:
        kept = F.when(want < 0, F.greatest(want, F.least(F.lit(0.0), low))).otherwise(F.least(want, F.greatest(F.lit(0.0), high)))
        return F.when(clip.isNull(), want).otherwise(kept)

    c = [F.get(clip, k) for k in range(4)]
    return room(c[0] - box[0], c[2] - box[2], dx), room(c[1] - box[1], c[3] - box[3], dy)


def local_move(ctm: Column, dx: Column, dy: Column) -> Column:
    """A move of the page in the space of a matrix, as a point; null if the matrix has no inverse."""
    a, b, c, d = (F.get(ctm, k) for k in range(4))
    det = a * d - b * c
    x, y = F.try_divide(d * dx - c * dy, det), F.try_divide(a * dy - b * dx, det)
    return F.when((F.abs(det) >= NONE) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")), point(x, y))


def moved(content: Column, ctm: Column, dx: Column, dy: Column) -> Column:
    """Content between a move and its inverse, so that what follows keeps its state; as it was if the matrix has no inverse or nothing would move."""
    by = local_move(ctm, dx, dy)
    none = by.isNull() | ((F.abs(by["x"]) < NONE) & (F.abs(by["y"]) < NONE))
    step = lambda x, y: F.concat(F.lit("1 0 0 1 "), _numbers(x, y), F.lit(" cm\n"))
    return F.when(none, content).otherwise(F.concat(step(by["x"], by["y"]), content, F.lit("\n"), step(-by["x"], -by["y"])))


def image_moved(name: Column, ctm: Column, dx: Column, dy: Column, scale: Column, removed: Column) -> Column:
    """Content that draws a picture elsewhere or in another size, growing from its own origin; nothing if it was removed, as it was if its matrix has no inverse."""
    by, size = local_move(ctm, dx, dy), F.when(scale > 0, scale.cast("double")).otherwise(1.0)
    draw = F.concat(F.lit("/"), name, F.lit(" Do"))
    put = F.concat(F.lit("q "), plain_number(size), F.lit(" 0 0 "), _numbers(size, by["x"], by["y"]), F.lit(" cm "), draw, F.lit(" Q"))
    return F.when(removed, "").when(by.isNull(), draw).otherwise(put)
