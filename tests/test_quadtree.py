"""Points in rings by cells, against the plain rule."""

import math
import random

import pytest

from dispatchlake.operators import quadtree, spatial

AREAS = "ord int, name string, rings array<array<struct<x: double, y: double>>>"


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[-1:] + ring[:-1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def star(rng, x, y, wide, n, places=2):
    """A ring of n corners, concave and with corners on round numbers."""
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(round(x + wide * rng.uniform(0.3, 1) * math.cos(a), places), round(y + wide * rng.uniform(0.3, 1) * math.sin(a), places)) for a in at]


@pytest.fixture(scope="module")
def rings():
    rng = random.Random(5)
    some = [star(rng, rng.uniform(-84, -82), rng.uniform(41, 43), rng.choice([0.02, 0.2, 1.0]), rng.choice([3, 5, 40])) for _ in range(25)]
    box = [(-83.5, 42.0), (-82.5, 42.0), (-82.5, 42.5), (-83.5, 42.5)]
    return [*some, box, star(rng, -83, 42, 1.5, 600, 6), [(-83.0, 42.0), (-83.0, 42.0), (-83.0, 42.0)], [(0.0, 0.0), (1.0, 1.0)], [(-179.0, -80.0), (179.0, -80.0), (179.0, 80.0), (-179.0, 80.0)]]


def frame(spark, rings):
    return spark.createDataFrame([(i, f"a{i}", [[{"x": x, "y": y} for x, y in r]]) for i, r in enumerate(rings)], AREAS)


def test_points_in_rings(spark, rings):
    rng = random.Random(6)
    points = [(i, round(rng.uniform(40.9, 43.1), 2), round(rng.uniform(-84.1, -81.9), 2)) for i in range(700)]
    points += [(1000 + i, y, x) for i, (x, y) in enumerate(p for r in rings for p in r[:12])] + [(5000, None, -83.0), (5001, 42.0, None)]
    want = {(k, o) for k, y, x in points for o, r in enumerate(rings) if len(r) > 2 and x is not None and y is not None and inside(x, y, r)}
    cells = quadtree.cover(frame(spark, rings))
    got = [(r.k, r.ord) for r in quadtree.held(spark.createDataFrame(points, "k int, lat double, lng double"), cells).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = {k: min((o for j, o in want if j == k), default=None) for k, _, _ in points}
    got = {r.k: r.area for r in spatial.containing(spark.createDataFrame(points, "k int, lat double, lng double"), frame(spark, rings)).collect()}
    assert got == {k: None if o is None else f"a{o}" for k, o in first.items()}


def test_cells_hold_few_edges(spark, rings):
    turn = [2 * math.pi * i / 600 for i in range(600)]
    smooth = [(-83 + (1 + 0.01 * math.sin(9 * a)) * math.cos(a), 42 + (1 + 0.01 * math.sin(9 * a)) * math.sin(a)) for a in turn]
    cells = quadtree.cover(frame(spark, [smooth])).collect()
    assert sum(len(c.edges) for c in cells) < 2 * 600 and max(len(c.edges) for c in cells) <= quadtree.FEW
    assert sum(not c.edges for c in cells) > 0
    # long edges that go to and fro lie in many cells each, yet in few beside the whole ring in each
    jagged = quadtree.cover(frame(spark, rings[-4:-3])).collect()
    assert max(len(c.edges) for c in jagged) <= quadtree.FEW and sum(len(c.edges) for c in jagged) < len(jagged) * 600 / 50
    deep = quadtree.cover(frame(spark, rings[-4:-3]), few=0, depth=2).collect()
    assert sum(len(c.edges) for c in deep) >= 600


def test_none(spark, rings):
    points = spark.createDataFrame([(1, 42.2, -83.0)], "k int, lat double, lng double")
    for areas in (frame(spark, rings).limit(0), spark.createDataFrame([(1, "a", [[{"x": None, "y": 1.0}, {"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}]]), (2, "b", None)], AREAS)):
        assert [r.area for r in spatial.containing(points, areas).collect()] == [None]
    assert spatial.containing(points.limit(0), frame(spark, rings)).count() == 0
