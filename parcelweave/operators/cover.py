"""Shapes as quadtree cells: those wholly inside need no test, those on the border carry their own sides only.

A cell ``(level, cx, cy)`` is the square of side ``2 ** -level`` whose lower left corner is ``(cx, cy)`` times
that.  A border cell knows, for each polygon, whether its corner is inside; a point of the cell is inside if
the way from the corner up and then to the right crosses an odd number of the cell's sides more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.operators.polygons import Shapes
from parcelweave.shipping import many_tasks, ship

#: Sides that a border cell may carry; cells with more are divided, at most ``DEEPEST`` times, as many sides may meet in a point.
MOST_SIDES, DEEPEST = 8, 24
#: The finest level: a shape about the origin that is smaller than such a cell, or a point, is not divided.
FINEST = 100
#: How many times its sides a shape's undecided cells may hold; beyond it, as where many sides lie on each other, they stay as they are.
GROWTH = 64
CELLS = "array<struct<level:int,cx:bigint,cy:bigint,parts:array<struct<odd:boolean,sides:array<struct<ax:double,ay:double,bx:double,by:double>>>>>>"


def _turns(side: np.ndarray, x0, y0, px, py) -> np.ndarray:
    """For each side, whether the way from ``(x0, y0)`` up to ``py`` and then to ``px`` crosses it.

    The ends of a side's part between the heights are compared with ``x0``, and both rings' neighbours
    compare a shared end alike, so that the parity over closed rings is that of whole rays, whatever is rounded.
    """
    ax, ay, bx, by = side.T
    with np.errstate(divide="ignore", invalid="ignore"):
        low, high = ((bx - ax) * (h - ay) / (by - ay) + ax for h in (y0, py))
    over_a, over_b, above_a, above_b = ay > y0, by > y0, ay > py, by > py
    lower = np.where(over_a != over_b, low, np.where(ay <= by, ax, bx))
    upper = np.where(above_a != above_b, high, np.where(ay <= by, bx, ax))
    up = (over_a | over_b) & ~(above_a & above_b) & ((x0 < lower) != (x0 < upper))
    across = (above_a != above_b) & ((px < high) != (x0 < high))
    return up ^ across


def _meets(side: np.ndarray, x, y, size) -> np.ndarray:
    """Whether a side may touch a square: generous by far more than rounding."""
    ax, ay, bx, by = side.T
    half = size / 2
    wide = half + 1e-9 * (size + np.abs(side).max(axis=1, initial=0.0))
    cx, cy = x + half, y + half
    near = (np.minimum(ax, bx) <= cx + wide) & (np.maximum(ax, bx) >= cx - wide) & (np.minimum(ay, by) <= cy + wide) & (np.maximum(ay, by) >= cy - wide)
    dx, dy = bx - ax, by - ay
    return near & (np.abs(dx * (cy - ay) - dy * (cx - ax)) <= (np.abs(dx) + np.abs(dy)) * wide)


def _by(owner: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)


def cells_of(shapes: Shapes, most: int = MOST_SIDES) -> pa.Array:
    """The cells of each shape of a batch, all shapes divided together, a level at a time."""
    side, ring = shapes.sides()
    polygon, shape = shapes.owners()
    part = polygon[ring] if len(ring) else ring
    fine = np.isfinite(side).all(axis=1)
    side, part = side[fine], part[fine]
    own = shape[part] if len(part) else part
    n = len(shapes)
    low, high, reach = np.full((n, 2), np.inf), np.full((n, 2), -np.inf), np.zeros(n)
    for a in (0, 2):
        np.minimum.at(low, own, side[:, a : a + 2])
        np.maximum.at(high, own, side[:, a : a + 2])
    np.maximum.at(reach, own, np.abs(side).max(axis=1, initial=0.0))
    some = np.unique(own)
    finest = np.minimum(FINEST, 40 - np.ceil(np.log2(np.maximum(reach[some], 1e-300))))  # beyond it corners are no longer exact
    root = np.minimum(-np.ceil(np.log2(np.maximum((high - low)[some].max(axis=1), 1e-300))), finest)
    size = 2.0**-root
    first = np.floor(low[some] / size[:, None])
    spans = [(first + (i, j), i, j) for i in (0, 1) for j in (0, 1)]
    c_shape, c_level = np.tile(some, 4), np.tile(root, 4)
    c_at = np.concatenate([s[0] for s in spans])
    # corners of these cells: their parity is that of the way from the lowest cell's corner, which is outside
    parts = np.unique(part)
    place = np.searchsorted(some, shape[parts]) if len(parts) else parts
    p_cell = np.concatenate([place + k * len(some) for k in range(4)]) if len(parts) else np.empty(0, int)
    p_odd = np.zeros(len(p_cell), bool)
    s_part = np.searchsorted(parts, part)
    s_p = np.concatenate([s_part + k * len(parts) for k in range(4)]) if len(parts) else np.empty(0, int)
    s_side = np.tile(np.arange(len(side)), 4)
    p_part = np.tile(parts, 4)
    if len(parts):
        cell = p_cell[s_p]
        x, y = (c_at[cell] * (2.0 ** -c_level[cell])[:, None]).T
        x0, y0 = (first * size[:, None])[place[s_p % len(parts)]].T
        # from outside: below all sides and left of them, by whole rays
        p_odd = np.bincount(s_p, _turns(side[s_side], x0 - size[place[s_p % len(parts)]], y0 - size[place[s_p % len(parts)]], x, y), len(p_cell)).astype(int) % 2 == 1
        stay = _meets(side[s_side], x, y, 2.0 ** -c_level[cell])
        s_p, s_side = s_p[stay], s_side[stay]
    c_deep = np.zeros(len(c_shape), int)
    c_last = np.minimum(np.tile(root, 4) + DEEPEST, np.tile(finest, 4))
    owned, done = np.bincount(own, minlength=n), []
    while len(p_cell):
        held = np.bincount(s_p, minlength=len(p_cell))
        use = p_odd | (held > 0)
        whole = np.zeros(len(c_shape), bool)
        whole[p_cell[p_odd & (held == 0)]] = True
        total = np.bincount(p_cell, held, len(c_shape))
        spread = np.bincount(c_shape[p_cell[s_p]], minlength=n) > GROWTH * (owned + most)
        border = ~whole & (total > 0) & ((total <= most) | (c_level >= c_last) | spread[c_shape])
        done.append((c_shape[whole], c_level[whole], c_at[whole], None))
        take = use & border[p_cell]
        new_p = np.cumsum(take) - 1
        s_take = take[s_p]
        new_c = np.cumsum(border) - 1
        done.append((c_shape[border], c_level[border], c_at[border], (new_c[p_cell[take]], p_odd[take], new_p[s_p[s_take]], s_side[s_take])))
        go_c = ~whole & ~border & (total > 0)
        go_p = use & go_c[p_cell]
        go_s = go_p[s_p]
        new_c, new_p = np.cumsum(go_c) - 1, np.cumsum(go_p) - 1
        s_p, s_side = new_p[s_p[go_s]], s_side[go_s]
        p_cell, p_part, p_odd = new_c[p_cell[go_p]], p_part[go_p], p_odd[go_p]
        c_shape, c_level, c_at, c_last = c_shape[go_c], c_level[go_c], c_at[go_c], c_last[go_c]
        cell = p_cell[s_p]
        full = 2.0 ** -c_level[cell]
        (x0, y0), half, own_sides = (c_at[cell] * full[:, None]).T, full / 2, side[s_side]
        made_p, made_s = [], []
        for k, (i, j) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
            x, y = x0 + i * half, y0 + j * half
            odd = p_odd ^ (np.bincount(s_p, _turns(own_sides, x0, y0, x, y), len(p_cell)).astype(int) % 2 == 1)
            stay = _meets(own_sides, x, y, half)
            made_p.append((p_cell + k * len(c_shape), p_part, odd))
            made_s.append((s_p[stay] + k * len(p_cell), s_side[stay]))
        c_at = np.concatenate([2 * c_at + ij for ij in ((0, 0), (1, 0), (0, 1), (1, 1))])
        c_shape, c_level, c_last = np.tile(c_shape, 4), np.tile(c_level + 1, 4), np.tile(c_last, 4)
        p_cell, p_part, p_odd = (np.concatenate(z) for z in zip(*made_p, strict=True))
        s_p, s_side = (np.concatenate(z) for z in zip(*made_s, strict=True))
    return _as_arrow(done, side, shapes)


def _as_arrow(done: list, side: np.ndarray, shapes: Shapes) -> pa.Array:
    owners, structs = [], []
    for shape, level, at, parts in done:
        if not len(shape):
            continue
        n = len(shape)
        if parts is None:
            cell, odd, s_p, s_side, missing = np.empty(0, int), np.empty(0, bool), np.empty(0, int), np.empty(0, int), np.ones(n, bool)
        else:
            (cell, odd, s_p, s_side), missing = parts, np.zeros(n, bool)
        rank = np.argsort(cell, kind="stable")  # parts by their cell, sides by their part's new place
        place = np.empty(len(rank), int)
        place[rank] = np.arange(len(rank))
        by_p = np.argsort(place[s_p], kind="stable")
        values = pa.StructArray.from_arrays([pa.array(c) for c in side[s_side[by_p]].T], ["ax", "ay", "bx", "by"])
        lists = pa.ListArray.from_arrays(_by(place[s_p], len(cell)), values)
        held = pa.StructArray.from_arrays([pa.array(odd[rank]), lists], ["odd", "sides"])
        held = pa.ListArray.from_arrays(pa.array(_by(cell, n)), held, mask=pa.array(missing))
        owners.append(shape)
        structs.append(pa.StructArray.from_arrays([pa.array(level.astype(np.int32)), *[pa.array(c.astype(np.int64)) for c in at.T], held], ["level", "cx", "cy", "parts"]))
    owner = np.concatenate(owners) if owners else np.empty(0, int)
    order = np.argsort(owner, kind="stable")
    if structs:
        cells = pa.concat_arrays(structs).take(pa.array(order))
    else:
        numbers = pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")]))
        cells = pa.array([], pa.struct([("level", pa.int32()), ("cx", pa.int64()), ("cy", pa.int64()), ("parts", pa.list_(pa.struct([("odd", pa.bool_()), ("sides", numbers)])))]))
    return pa.ListArray.from_arrays(pa.array(_by(owner, len(shapes))), cells, mask=pa.array(shapes.missing))


def cover(shapes: DataFrame, key: str, most: int = MOST_SIDES, geometry: str = "geom") -> DataFrame:
    """``(key, level, cx, cy, parts)``: the cells of each shape; ``parts`` is null for cells wholly inside."""
    ship(shapes.sparkSession)

    @F.arrow_udf(CELLS)
    def run(column: pa.Array) -> pa.Array:
        return cells_of(Shapes.of(column), most)

    dealt = shapes.select(key, geometry).repartition(many_tasks(shapes.sparkSession))  # cells are large: a batch of few shapes in each task
    return dealt.select(key, F.explode(run(F.col(geometry))).alias("_cell")).select(key, "_cell.*")


def cell_of(x: Column, y: Column, level: int) -> Column:
    return F.struct(F.lit(level).alias("level"), F.floor(x * 2.0**level).alias("cx"), F.floor(y * 2.0**level).alias("cy"))


def held(x: Column, y: Column) -> Column:
    """Whether a cell's shape holds a point of the cell."""
    x0, y0 = (F.col(c) * F.pow(F.lit(2.0), -F.col("level")) for c in ("cx", "cy"))

    def turns(s: Column) -> Column:
        def at(h: Column) -> Column:
            return F.try_divide((s["bx"] - s["ax"]) * (h - s["ay"]), s["by"] - s["ay"]) + s["ax"]

        over_a, over_b, above_a, above_b = s["ay"] > y0, s["by"] > y0, s["ay"] > y, s["by"] > y
        rising = s["ay"] <= s["by"]
        lower = F.when(over_a != over_b, at(y0)).when(rising, s["ax"]).otherwise(s["bx"])
        upper = F.when(above_a != above_b, at(y)).when(rising, s["bx"]).otherwise(s["ax"])
        up = (over_a | over_b) & ~(above_a & above_b) & ((x0 < lower) != (x0 < upper))
        across = F.when(above_a != above_b, (x < at(y)) != (x0 < at(y))).otherwise(F.lit(False))
        return (up != across).cast("int")

    odd = F.exists("parts", lambda p: F.aggregate(p["sides"], p["odd"].cast("int"), lambda n, s: n + turns(s)) % 2 == 1)
    return F.col("parts").isNull() | odd
