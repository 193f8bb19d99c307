"""Boxes and polygons as column expressions.

A ``Box`` is four columns, so the same expressions serve flat columns, structs and lambda
variables inside higher-order functions; Catalyst sees plain arithmetic throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in cls._fields))

    @classmethod
    def struct(cls, s: Column, prefix: str = "") -> Box:
        return cls(*(s[f"{prefix}{c}"] for c in cls._fields))

    def as_struct(self) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(self, self._fields, strict=True)))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for c, n in zip(self, self._fields, strict=True)]


def area(a: Box) -> Column:
    return (a.x2 - a.x1) * (a.y2 - a.y1)


def overlap_area(a: Box, b: Box) -> Column:
    zero = F.lit(0)
    width = F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    return width * F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0.0 where the union is empty."""
    shared = overlap_area(a, b)
    union = area(a) + area(b) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(F.try_divide(shared.cast("double"), union.cast("double")))


def overlaps(a: Box, b: Box) -> Column:
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def union_box(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def _scaled(v: Column, by: Column, to: float) -> Column:
    return F.try_divide(v.cast("double"), by.cast("double")) * F.lit(float(to))


def normalize_box(a: Box, width: Column, height: Column, coordinate_max: float = 1000) -> Box:
    """Pixels to 0..coordinate_max; null where the page has no extent."""
    return Box(*(_scaled(v, d, coordinate_max) for v, d in zip(a, (width, height) * 2, strict=True)))


def normalize_polygon(points: Column, width: Column, height: Column, coordinate_max: float = 1000) -> Column:
    return F.transform(points, lambda p: F.struct(_scaled(p["x"], width, coordinate_max).alias("x"), _scaled(p["y"], height, coordinate_max).alias("y")))


def box_to_pixels(a: Box, width: Column, height: Column, coordinate_max: float = 1000, whole: bool = True) -> Box:
    """0..coordinate_max to pixels. Whole pixels round halves to even."""
    exact = [v.cast("double") / F.lit(float(coordinate_max)) * d.cast("double") for v, d in zip(a, (width, height) * 2, strict=True)]
    return Box(*(F.rint(v).cast("long") if whole else v for v in exact))


def polygon_to_pixels(points: Column, width: Column, height: Column, coordinate_max: float = 1000) -> Column:
    scaled = lambda v, d: F.rint(v.cast("double") / F.lit(float(coordinate_max)) * d.cast("double")).cast("long")
    return F.transform(points, lambda p: F.struct(scaled(p["x"], width).alias("x"), scaled(p["y"], height).alias("y")))


def clamp_box(a: Box, width: Column, height: Column) -> Box:
    """Rounded to pixels and held within the image; see ``has_extent`` for what is left of it."""
    return Box(*(F.greatest(F.lit(0), F.least(F.rint(v).cast("long"), d.cast("long"))) for v, d in zip(a, (width, height) * 2, strict=True)))


def expand_box(a: Box, padding: Column | float, width: Column, height: Column) -> Box:
    pad = padding if isinstance(padding, Column) else F.lit(padding)
    return clamp_box(Box(a.x1 - pad, a.y1 - pad, a.x2 + pad, a.y2 + pad), width, height)


def crop_box(a: Box, width: Column, height: Column, padding: Column | float = 0, normalized: bool = True, within: tuple[Column, Column] | None = None) -> Box:
    """The pixel rectangle that a crop of the region takes. ``within``: the size of the image it is cut
    from, where that isn't the one by which the box is scaled (an image that is turned)."""
    pixels = box_to_pixels(a, width, height) if normalized else a
    w, h = within or (width, height)
    return expand_box(clamp_box(pixels, w, h), padding, w, h)


def has_extent(a: Box) -> Column:
    return (a.x2 > a.x1) & (a.y2 > a.y1)


def valid_box(a: Box, coordinate_max: float = 1000) -> Column:
    """All coordinates within 0..coordinate_max, and some extent; false for nulls."""
    inside = [v.between(F.lit(0), F.lit(coordinate_max)) for v in a]
    return F.coalesce(inside[0] & inside[1] & inside[2] & inside[3] & has_extent(a), F.lit(False))


# Polygons. Spark has no areas of intersections, so these run on Arrow batches.


def _spans(polygon: np.ndarray, left: float, right: float) -> list[tuple[float, float, float, float]]:
    """The polygon's parts over a slab without vertices or crossings: lower and upper edge, each at
    both ends of the slab (even-odd rule)."""
    a, b = polygon, np.roll(polygon, -1, axis=0)
    a, b = np.where((a[:, :1] <= b[:, :1]), a, b), np.where((a[:, :1] <= b[:, :1]), b, a)
    on = (a[:, 0] <= left) & (b[:, 0] >= right) & (b[:, 0] > a[:, 0])
    a, b = a[on], b[on]
    slope = (b[:, 1] - a[:, 1]) / (b[:, 0] - a[:, 0])
    at = [a[:, 1] + slope * (x - a[:, 0]) for x in (left, right)]
    order = np.argsort(at[0] + at[1], kind="stable")
    y = list(zip(at[0][order].tolist(), at[1][order].tolist(), strict=True))
    return [(*y[i], *y[i + 1]) for i in range(0, len(y) - 1, 2)]


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of all crossings between edges of a and b."""
    p, r = a, np.roll(a, -1, axis=0) - a
    q, s = b, np.roll(b, -1, axis=0) - b
    cross = r[:, None, 0] * s[None, :, 1] - r[:, None, 1] * s[None, :, 0]
    d = q[None] - p[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (d[..., 0] * s[None, :, 1] - d[..., 1] * s[None, :, 0]) / cross
        u = (d[..., 0] * r[:, None, 1] - d[..., 1] * r[:, None, 0]) / cross
        hit = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        return (p[:, None, 0] + t * r[:, None, 0])[hit]


def polygon_areas(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Areas of a, b and their intersection, by the trapezoids between all vertices and crossings."""
    xs = np.unique(np.concatenate([a[:, 0], b[:, 0], _crossings(a, a), _crossings(b, b), _crossings(a, b)]))
    own_a = own_b = shared = 0.0
    for left, right in zip(xs[:-1].tolist(), xs[1:].tolist(), strict=True):
        parts = [_spans(p, left, right) for p in (a, b)]
        half = (right - left) / 2
        own_a += sum((u0 - l0 + u1 - l1) * half for l0, l1, u0, u1 in parts[0])
        own_b += sum((u0 - l0 + u1 - l1) * half for l0, l1, u0, u1 in parts[1])
        for l0, l1, u0, u1 in parts[0]:
            for m0, m1, v0, v1 in parts[1]:
                low, high = (max(l0, m0), max(l1, m1)), (min(u0, v0), min(u1, v1))
                if high[0] + high[1] > low[0] + low[1]:
                    shared += (high[0] - low[0] + high[1] - low[1]) * half
    return own_a, own_b, shared


def _convex(p: list[tuple[float, float]]) -> int:
    """1 or -1 for a convex polygon by its sense of rotation, 0 for any other."""
    sense = total = 0
    for (x0, y0), (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], p[2:] + p[:2], strict=True):
        turn = (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1)
        if turn:
            total += 1
            sense += 1 if turn > 0 else -1
    # one sense of rotation, and once around: x turns back twice
    backs = [1 if b[0] > a[0] else -1 for a, b in zip(p, p[1:] + p[:1], strict=True) if a[0] != b[0]]
    once = sum(a != b for a, b in zip(backs, backs[1:] + backs[:1], strict=True)) == 2
    return 0 if abs(sense) != total or not total or not once else 1 if sense > 0 else -1


def _shoelace(p: list[tuple[float, float]]) -> float:
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1], strict=True))) / 2


def _clipped(p: list[tuple[float, float]], by: list[tuple[float, float]], sense: int) -> list[tuple[float, float]]:
    """What of p lies on the inner side of every edge of a convex polygon."""
    for (ax, ay), (bx, by_) in zip(by, by[1:] + by[:1], strict=True):
        inside = [sense * ((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) for x, y in p]
        out = []
        for (x0, y0), (x1, y1), d0, d1 in zip(p, p[1:] + p[:1], inside, inside[1:] + inside[:1], strict=True):
            if d0 >= 0:
                out.append((x0, y0))
            if (d0 > 0 > d1) or (d0 < 0 < d1):
                t = d0 / (d0 - d1)
                out.append((x0 + t * (x1 - x0), y0 + t * (y1 - y0)))
        p = out
        if len(p) < 3:
            return []
    return p


def areas(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> tuple[float, float, float]:
    """Areas of two polygons and of their intersection; convex ones are clipped, others cut in slabs."""
    sense = _convex(b)
    if sense and _convex(a):
        rest = _clipped(a, b, sense)
        return _shoelace(a), _shoelace(b), _shoelace(rest) if rest else 0.0
    return polygon_areas(np.array(a), np.array(b))


def _shape(polygon: list | None, box: dict) -> list[tuple[float, float]]:
    if polygon and len(polygon) >= 3:
        points = [(float(p["x"]), float(p["y"])) for p in polygon]
        if _convex(points) or polygon_areas(np.array(points), np.array(points))[0] > 0:
            return points
    return [(box["x1"], box["y1"]), (box["x2"], box["y1"]), (box["x2"], box["y2"]), (box["x1"], box["y2"])]


def _sense_of(p: np.ndarray) -> np.ndarray:
    """``_convex`` of many polygons of as many points (polygon, point, x and y)."""
    a, b, c = p, np.roll(p, -1, axis=1), np.roll(p, -2, axis=1)
    turns = np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - b[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - b[..., 0]))
    sense, total = turns.sum(axis=1), (turns != 0).sum(axis=1)
    backs = np.sign(b[..., 0] - a[..., 0])
    for _ in range(p.shape[1]):  # an edge straight up goes on as the one before it
        backs = np.where(backs == 0, np.roll(backs, 1, axis=1), backs)
    once = (backs != np.roll(backs, -1, axis=1)).sum(axis=1) == 2
    with np.errstate(invalid="ignore"):
        return np.where((np.abs(sense) == total) & (total > 0) & once, np.sign(sense), 0)


def _areas_of(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``_shoelace`` of many polygons, each of its own number of points."""
    out = np.zeros(len(p))
    for i in range(p.shape[1]):
        here, there = p[:, i], p[np.arange(len(p)), np.where(i + 1 < sizes, i + 1, 0) % p.shape[1]]
        out += np.where(i < sizes, here[:, 0] * there[:, 1] - there[:, 0] * here[:, 1], 0.0)
    return np.abs(out) / 2


def _clipped_areas(p: np.ndarray, by: np.ndarray, sense: np.ndarray) -> np.ndarray:
    """Areas of what of each p lies in the convex polygon beside it: ``_clipped``, many at once."""
    sizes = np.full(len(p), p.shape[1])
    rows = np.arange(len(p))[:, None]
    for i in range(by.shape[1]):
        a, b = by[:, i, None], by[:, (i + 1) % by.shape[1], None]
        nth = np.arange(p.shape[1])[None]
        there = p[rows, np.where(nth + 1 < sizes[:, None], nth + 1, 0) % p.shape[1]]
        side = lambda q: sense[:, None] * ((b[..., 0] - a[..., 0]) * (q[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (q[..., 0] - a[..., 0]))  # noqa: E731, B023
        d0, d1 = side(p), side(there)
        stays = (nth < sizes[:, None]) & (d0 >= 0)
        cut = (nth < sizes[:, None]) & (((d0 > 0) & (d1 < 0)) | ((d0 < 0) & (d1 > 0)))
        n = stays.astype(np.int64) + cut
        start = np.cumsum(n, axis=1) - n
        sizes = n.sum(axis=1)
        new = np.zeros((len(p), max(1, int(sizes.max(initial=0))), 2))
        r, c = np.nonzero(stays)
        new[r, start[r, c]] = p[r, c]
        r, c = np.nonzero(cut)
        t = (d0[r, c] / (d0[r, c] - d1[r, c]))[:, None]
        new[r, start[r, c] + stays[r, c]] = p[r, c] + t * (there[r, c] - p[r, c])
        p, sizes = new, np.where(sizes < 3, 0, sizes)
    return _areas_of(p, sizes)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of points of each polygon, where they start, and all points (nan for nulls)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return sizes, np.cumsum(sizes) - sizes, np.stack([pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "xy"], axis=1)


def _polygon_iou(pairs: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Convex polygons are clipped together with those of as many points, others one by one."""
    for columns in pairs:
        (n_a, at_a, a), (n_b, at_b, b) = (_points(columns[i]) for i in (0, 2))
        out, done = np.zeros(len(n_a)), np.zeros(len(n_a), dtype=bool)
        for i, j in {*zip(n_a.tolist(), n_b.tolist(), strict=True)}:
            if min(i, j) < 3:
                continue
            rows = np.nonzero((n_a == i) & (n_b == j))[0]
            one, other = a[at_a[rows, None] + np.arange(i)], b[at_b[rows, None] + np.arange(j)]
            sense = _sense_of(other)
            both = (sense != 0) & (_sense_of(one) != 0)
            rows, one, other, sense = rows[both], one[both], other[both], sense[both]
            shared = _clipped_areas(one, other, sense)
            union = _areas_of(one, np.full(len(one), i)) + _areas_of(other, np.full(len(other), j)) - shared
            out[rows], done[rows] = np.divide(shared, union, out=np.zeros(len(rows)), where=union != 0), True
        rest = np.nonzero(~done)[0]
        for nth, pa_, ba, pb, bb in zip(rest.tolist(), *(c.take(pa.array(rest)).to_pylist() for c in columns), strict=True):
            own_a, own_b, shared = areas(_shape(pa_, ba), _shape(pb, bb))
            union = own_a + own_b - shared
            out[nth] = shared / union if union else 0.0
        yield pa.array(out, type=pa.float64())


def region_iou(polygon_a: Column, a: Box, polygon_b: Column, b: Box) -> Column:
    """IoU of polygons of three points or more, of the boxes where there is none. Polygons that
    cross themselves are filled by the even-odd rule."""
    points = "array<struct<x:double,y:double>>"
    as_doubles = lambda x: Box(*(c.cast("double") for c in x)).as_struct()
    return F.arrow_udf(_polygon_iou, DoubleType())(polygon_a.cast(points), as_doubles(a), polygon_b.cast(points), as_doubles(b))
