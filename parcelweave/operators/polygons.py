"""Polygons: containment and text as expressions; area, centre, simplification and label points in Python workers.

A geometry is a list of polygons; a polygon is its outer ring and its holes; a ring is a closed
list of points.  Workers get geometries as Arrow lists: flat coordinates and offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]
Ring = Sequence[Point]
Polygon = Sequence[Ring]

POINT = "struct<x:double,y:double>"
GEOMETRY = f"array<array<array<{POINT}>>>"
#: Distances between points and sides that are held at once.
BLOCK = 1 << 20


def _sides(polygon: Polygon) -> np.ndarray:
    """``ax, ay, bx, by`` of each side of all rings."""
    own = [np.asarray(ring, dtype=float).reshape(-1, 2) for ring in polygon]
    return np.concatenate([np.hstack((r[:-1], r[1:])) for r in own]) if own else np.empty((0, 4))


def ring_area(ring: Ring) -> float:
    """Signed; positive against the clock."""
    ax, ay, bx, by = _sides([ring]).T
    return float((ax * by - bx * ay).sum() / 2)


def area(polygon: Polygon) -> float:
    return abs(ring_area(polygon[0])) - sum(abs(ring_area(r)) for r in polygon[1:]) if len(polygon) else 0.0


def to_edges(x: np.ndarray, y: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """The distance of each point to the nearest side; negative outside, by the number of sides that a ray crosses."""
    out = np.empty(len(x))
    ax, ay, bx, by = sides.T
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    step = max(1, BLOCK // max(len(sides), 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        for at in range(0, len(x), step):
            px, py = x[at : at + step, None], y[at : at + step, None]
            t = np.clip(np.where(length > 0, ((px - ax) * dx + (py - ay) * dy) / length, 0.0), 0.0, 1.0)
            near = np.hypot(px - ax - t * dx, py - ay - t * dy).min(axis=1)
            crossed = ((ay > py) != (by > py)) & (px < dx * (py - ay) / dy + ax)
            out[at : at + step] = np.where(crossed.sum(axis=1) % 2 == 1, near, -near)
    return out


def to_edge(p: Point, polygon: Polygon) -> float:
    """The distance to the nearest side; negative outside."""
    return float(to_edges(np.array([p[0]]), np.array([p[1]]), _sides(polygon))[0])


def inside(p: Point, polygon: Polygon) -> bool:
    """By the number of sides that a ray crosses; holes turn it around."""
    ax, ay, bx, by = _sides(polygon).T
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = ((ay > p[1]) != (by > p[1])) & (p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax)
    return bool(crossed.sum() % 2)


def kept(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the points that stay of a closed ring: not those within ``tolerance`` of the line that is left (Douglas and Peucker, 1973); four at least."""
    last = len(xy) - 1
    if last < 4:
        return np.arange(last + 1)
    keep, waiting = {0, last}, [(0, last)]
    while waiting:
        a, b = waiting.pop()
        if b - a < 2:
            continue
        (px, py), (dx, dy) = (xy[a + 1 : b] - xy[a]).T, xy[b] - xy[a]
        length = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length, 0.0, 1.0) if length else 0.0
        far = np.hypot(px - t * dx, py - t * dy)
        at = int(far.argmax())
        if far[at] > tolerance:
            keep.add(a + 1 + at)
            waiting += [(a, a + 1 + at), (a + 1 + at, b)]
    if len(keep) < 4:
        step = max(1, (last + 1) // 3)
        keep |= {step, min(2 * step, last - 1)}
    return np.array(sorted(keep))


def simplify(ring: Ring, tolerance: float) -> list[Point]:
    """A ring's points that stay, see ``kept``."""
    return [ring[i] for i in kept(np.asarray(ring, dtype=float).reshape(-1, 2), tolerance)]


def label_point(polygon: Polygon, precision: float = 0.01) -> Point | None:
    """The centre of the largest circle inside, to ``precision`` of its radius.

    Squares that may still hold a better centre are divided, all of one size at once.
    """
    sides = _sides(polygon)
    if not len(sides):
        return tuple(map(float, polygon[0][0])) if len(polygon) and len(polygon[0]) else None
    outer = np.asarray(polygon[0], dtype=float)
    low, high = outer.min(axis=0), outer.max(axis=0)
    side = float((high - low).min())
    if side <= 0:
        return float(outer[0, 0]), float(outer[0, 1])
    half = side / 2
    x, y = (c.ravel() for c in np.meshgrid(np.arange(low[0], high[0], side) + half, np.arange(low[1], high[1], side) + half))
    best = centre([polygon]) or (float(outer[0, 0]), float(outer[0, 1]))
    radius = to_edge(best, polygon)
    while len(x):
        d = to_edges(x, y, sides)
        top = int(d.argmax())
        if d[top] > radius:
            best, radius = (float(x[top]), float(y[top])), float(d[top])
        open_ = d + half * np.sqrt(2) - radius > max(precision * max(radius, 0.0), 1e-9 * side)
        x, y, half = x[open_], y[open_], half / 2
        x, y = np.concatenate([x + a * half for a in (-1, -1, 1, 1)]), np.concatenate([y + b * half for b in (-1, 1, -1, 1)])
    return best


def _flat(lists: pa.Array) -> pa.Array:
    return lists.flatten() if len(lists) else pa.array([], lists.type.value_type)  # an empty array from Spark has no offsets to read


def _offsets(lists: pa.Array) -> np.ndarray:
    if not len(lists):
        return np.zeros(1, np.int32)
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)


@dataclass
class Shapes:
    """A batch of geometries: coordinates, and where rings, polygons and shapes begin; lists that are null are empty."""

    xy: np.ndarray
    rings: np.ndarray
    polygons: np.ndarray
    shapes: np.ndarray
    missing: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Shapes:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        polygons = _flat(column)
        rings = _flat(polygons)
        points = _flat(rings)
        xy = np.column_stack([pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"])
        return cls(xy, _offsets(rings), _offsets(polygons), _offsets(column), np.asarray(column.is_null()))

    def __len__(self) -> int:
        return len(self.missing)

    def polygons_of(self, shape: int) -> list[list[np.ndarray]]:
        r = self.rings
        return [[self.xy[r[i] : r[i + 1]] for i in range(self.polygons[p], self.polygons[p + 1])] for p in range(self.shapes[shape], self.shapes[shape + 1])]

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """All sides, and the ring of each."""
        starts = np.ones(max(len(self.xy) - 1, 0), bool)
        ends = self.rings[1:-1]
        starts[ends[(ends > 0) & (ends < len(self.xy))] - 1] = False  # from one ring's last point to the next one's first
        at = np.flatnonzero(starts)
        return np.hstack((self.xy[at], self.xy[at + 1])), np.searchsorted(self.rings, at, side="right") - 1

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """The polygon of each ring and the shape of each polygon."""
        return np.repeat(np.arange(len(self.polygons) - 1), np.diff(self.polygons)), np.repeat(np.arange(len(self)), np.diff(self.shapes))

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each shape, weighed by area, holes against it; without area not a number."""
        (ax, ay, bx, by), ring = (lambda s: (s[0].T, s[1]))(self.sides())
        polygon, shape = self.owners()
        n, cross = len(self.rings) - 1, ax * by - bx * ay
        first = np.isin(np.arange(n), self.polygons[:-1])
        sign = np.where(np.bincount(ring, cross, n) < 0, -1.0, 1.0) * np.where(first, 1.0, -1.0)
        at, cross = shape[polygon[ring]] if len(ring) else ring, cross * sign[ring]
        total, sx, sy = (np.bincount(at, c, len(self)) for c in (cross / 2, (ax + bx) * cross / 6, (ay + by) * cross / 6))
        with np.errstate(divide="ignore", invalid="ignore"):
            return sx / total, sy / total


def arrow_shapes(geometry: Sequence[Polygon]) -> pa.Array:
    """One geometry as a batch."""
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    return pa.array([[[[{"x": float(p[0]), "y": float(p[1])} for p in ring] for ring in polygon] for polygon in geometry]], pa.list_(pa.list_(pa.list_(point))))


def centre(geometry: Sequence[Polygon]) -> Point | None:
    """The centroid, weighed by area; holes count against it."""
    x, y = Shapes.of(arrow_shapes(geometry)).centres()
    return (float(x[0]), float(y[0])) if np.isfinite(x[0]) else None


def _points(x: np.ndarray, y: np.ndarray) -> pa.Array:
    missing = ~(np.isfinite(x) & np.isfinite(y))
    return pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"], mask=pa.array(missing))


def simplified(geometry: Column, tolerance: float) -> Column:
    """Each ring simplified."""
    @F.arrow_udf(GEOMETRY)
    def run(column: pa.Array) -> pa.Array:
        s = Shapes.of(column)
        places = [s.rings[i] + kept(s.xy[s.rings[i] : s.rings[i + 1]], tolerance) for i in range(len(s.rings) - 1)]
        xy = s.xy[np.concatenate(places).astype(int)] if places else s.xy
        rings = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int32), _points(*xy.T))
        polygons = pa.ListArray.from_arrays(s.polygons, rings)
        return pa.ListArray.from_arrays(pa.array(s.shapes), polygons, mask=pa.array(s.missing))

    return run(geometry)


def label_of(geometry: Column) -> Column:
    """The label point of the largest polygon."""
    @F.arrow_udf(POINT)
    def run(column: pa.Array) -> pa.Array:
        s = Shapes.of(column)
        out = np.full((len(s), 2), np.nan)
        for i in range(len(s)):
            largest = max(s.polygons_of(i), key=area, default=None)
            if largest and (at := label_point(largest)):
                out[i] = at
        return _points(*out.T)

    return run(geometry)


def centre_of(geometry: Column) -> Column:
    @F.arrow_udf(POINT)
    def run(column: pa.Array) -> pa.Array:
        return _points(*Shapes.of(column).centres())

    return run(geometry)


def contains(geometry: Column, x: Column, y: Column) -> Column:
    """Whether any polygon holds a point, by the number of sides that a ray crosses; in Spark expressions."""
    def crosses(a: Column, b: Column) -> Column:
        at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))

    def crossings(ring: Column) -> Column:
        inner = F.greatest(F.size(ring) - 1, F.lit(0))
        sides = F.zip_with(F.slice(ring, F.lit(1), inner), F.slice(ring, F.lit(2), inner), lambda a, b: crosses(a, b).cast("int"))
        return F.aggregate(sides, F.lit(0), lambda n, c: n + c)

    def odd(polygon: Column) -> Column:
        return F.aggregate(F.transform(polygon, crossings), F.lit(0), lambda n, c: n + c) % 2 == 1

    return F.exists(geometry, odd)


def as_text(geometry: Column) -> Column:
    """Well-known text: ``POLYGON`` for one polygon, else ``MULTIPOLYGON``; ``EMPTY`` without any."""
    def ring(points: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(points, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ","), F.lit(")"))

    polygons = F.transform(geometry, lambda polygon: F.concat(F.lit("("), F.array_join(F.transform(polygon, ring), ","), F.lit(")")))
    return F.when(F.size(geometry) == 0, "POLYGON EMPTY").when(F.size(geometry) == 1, F.concat(F.lit("POLYGON"), F.get(polygons, F.lit(0)))).when(F.size(geometry) > 1, F.concat(F.lit("MULTIPOLYGON("), F.array_join(polygons, ","), F.lit(")")))


def point_text(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def geojson(geometry: Column) -> Column:
    """GeoJSON of a geometry whose points are degrees."""
    plain = F.transform(geometry, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    one = F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.get(plain, F.lit(0))), F.lit("}"))
    return F.when(F.size(geometry) == 1, one).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(plain), F.lit("}")))
