import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelweave.operators import cover as cv
from parcelweave.operators import polygons as pg
from parcelweave.plans.maps import located

corner = st.tuples(st.integers(-20, 20), st.integers(-20, 20))
ring = st.lists(corner, min_size=1, max_size=40).map(lambda ps: [(float(x), float(y)) for x, y in [*ps, ps[0]]])
shape = st.lists(st.lists(ring, min_size=1, max_size=2), max_size=2)


@settings(max_examples=25, deadline=None)
@given(st.lists(shape, min_size=1, max_size=3), st.sampled_from([0.0, 0.1, 1e6]), st.integers(1, 8))
def test_cells_equal_ray_casting(shapes, shift, most):
    moved = [[[[(x + shift, y - shift) for x, y in r] for r in p] for p in s] for s in shapes]
    cells = cv.cells_of(pg.Shapes.of(pa.concat_arrays([pg.arrow_shapes(s) for s in moved])), most).to_pylist()
    for geometry, own in zip(moved, cells, strict=True):
        at = {(c["level"], c["cx"], c["cy"]): c["parts"] for c in own}
        assert len(at) == len(own)
        levels = {c["level"] for c in own}
        for x, y in [(i / 2 + shift, j / 2 - shift) for i in range(-42, 43, 9) for j in range(-42, 43, 7)]:
            hits = [k for n in levels if (k := (n, int(np.floor(x * 2.0**n)), int(np.floor(y * 2.0**n)))) in at]
            assert len(hits) <= 1
            got = False
            for n, cx, cy in hits:
                parts = at[n, cx, cy]
                sides = [np.array([list(s.values()) for s in p["sides"]]).reshape(-1, 4) for p in parts or []]
                got = parts is None or any((p["odd"] + cv._turns(s, cx * 2.0**-n, cy * 2.0**-n, x, y).sum()) % 2 for p, s in zip(parts, sides, strict=True))
            assert got == any(pg.inside((x, y), p) for p in geometry)


@pytest.fixture(scope="module")
def city(spark):
    """A star of 2,000 corners, a square with a square hole, two squares that overlap, a null and an empty shape; half of all points in one spot."""
    a = np.linspace(0, 2 * np.pi, 2001)
    r = np.where(np.arange(2001) % 2, 400.0, 300.0)
    star = np.column_stack((500 + r * np.cos(a), 500 + r * np.sin(a)))
    star[-1] = star[0]

    def square(x, y, w):
        return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]

    rows = [(1, [[star.tolist()]]), (2, [[square(0.0, 0.0, 256.0), square(64.0, 64.0, 64.0)]]), (3, [[square(600.0, 600.0, 300.0)], [square(700.0, 700.0, 300.0)]]), (4, None), (5, [])]
    shapes = spark.createDataFrame([(k, g and [[[{"x": x, "y": y} for x, y in ring] for ring in p] for p in g]) for k, g in rows], f"id int, geom {pg.GEOMETRY}")
    rng = np.random.default_rng(3)
    spread = [*rng.uniform(-20, 1020, (1500, 2)).tolist(), *[[500.5, 650.0 + i / 4000] for i in range(1500)], [64.0, 100.0], [128.0, 100.0], [0.0, 0.0], [256.0, 256.0]]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spread)] + [(-1, None, 1.0), (-2, float("nan"), 1.0), (-3, 1e300, 1e300), (0, *spread[0])], "n long, x double, y double")
    return points, shapes


@pytest.mark.parametrize("most", [1, 8, 100_000])
def test_located_equals_containment(city, most):
    points, shapes = city
    want = points.where("x < 1e9").crossJoin(shapes).where(pg.contains(F.col("geom"), F.col("x"), F.col("y"))).select("n", "id").collect()
    assert sorted(want) == sorted(located(points, shapes, "id", most).select("n", "id").collect()) and len(want) > 1000


def test_sides_by_cell_are_few(city):
    cells = cv.cover(city[1], "id", 8).cache()
    most = cells.select(F.max(F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["sides"])))).first()[0]
    assert most <= 8 and cells.where("id = 1 AND parts IS NULL").count() > 0
    assert cells.where("id = 1").count() < 6 * 2000


def test_nothing_to_locate(city):
    points, shapes = city
    assert located(points, shapes.where("id > 3"), "id").count() == 0 == located(points.limit(0), shapes, "id").count()


def test_shapes_by_arrow(city, spark):
    got = {r.id: r for r in city[1].select("id", pg.simplified(F.col("geom"), 1.0).alias("s"), pg.label_of(F.col("geom")).alias("l"), pg.centre_of(F.col("geom")).alias("c")).collect()}
    assert got[4].s is None and got[4].l is None and got[4].c is None and got[5].s == [] and got[5].l is None and got[5].c is None
    assert [len(r) for r in got[2].s[0]] == [5, 5] and len(got[3].s) == 2
    hole = 256 * 256 * 128 - 64 * 64 * 96
    assert abs(got[2].c.x - hole / (256 * 256 - 64 * 64)) < 1e-9 and abs(got[1].c.x - 500) < 1
    grid = [pg.to_edge((x, y), [[(p.x, p.y) for p in r] for r in got[2].s[0]]) for x in range(0, 257, 2) for y in range(0, 257, 2)]
    assert pg.to_edge((got[2].l.x, got[2].l.y), [[(p.x, p.y) for p in r] for r in got[2].s[0]]) >= 0.99 * max(grid)


def test_point_at_the_origin_has_coarse_cells():
    """Levels stay so low that a point's cell is a finite number."""
    at_zero, tiny = [[[(0.0, 0.0)] * 3]], [[[(0.0, 0.0), (1e-290, 0.0), (0.0, 1e-290), (0.0, 0.0)]]]
    cells = cv.cells_of(pg.Shapes.of(pa.concat_arrays([pg.arrow_shapes(s) for s in (at_zero, tiny)])), 1).to_pylist()
    assert cells[0] and cells[1] and all(c["level"] <= cv.FINEST and np.isfinite(21 * 2.0 ** c["level"]) for own in cells for c in own)
