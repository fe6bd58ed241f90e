"""Unions and overlaps of polygons against fine rasters and plain figures."""

import math
import random

import numpy as np
import pytest

from parasol.operators.overlay import named, overlay_areas

SCHEMA = "key int, side string, part int, polygon array<array<array<double>>>"


def square(x, y, w, h):
    return [[float(x), float(y)], [float(x + w), float(y)], [float(x + w), float(y + h)], [float(x), float(y + h)]]


def areas(spark, rows, size=5.0):
    return {r.key: (r.area_a, r.area_b, r.area_union, r.area_both) for r in overlay_areas(spark.createDataFrame(rows, SCHEMA), size).collect()}


def test_shared_edges_holes_and_copies(spark):
    hole = [square(0, 0, 10, 10), square(2, 2, 3, 3)]
    bow = [[[0.0, 0.0], [10.0, 10.0], [10.0, 0.0], [0.0, 10.0]]]
    rows = [
        (1, "a", 0, [square(0, 0, 10, 10)]), (1, "b", 1, [square(10, 0, 10, 10)]),
        (2, "a", 0, [square(0, 0, 10, 10)]), (2, "b", 1, [square(0, 0, 10, 10)]), (2, "b", 2, [square(0, 0, 10, 10)]),
        (3, "a", 0, hole), (3, "b", 1, [square(2, 2, 3, 3)]),
        (4, "a", 0, bow), (4, "b", 1, [square(0, 0, 20, 5)]),
        (5, "a", 0, [square(0, 0, 10, 10)]), (5, "a", 1, [square(5, 5, 10, 10)]), (5, "a", 2, [square(5, 0, 5, 20)]),
        (6, "a", 0, [[[0.0, 0.0], [1.0, 1.0]]]), (7, "a", 0, None), (None, "a", 0, hole), (8, "a", 0, []), (9, "a", 0, [square(0, 0, 10, 10)] * 2),
    ]
    got = areas(spark, rows)
    expected = {1: (100, 100, 200, 0), 2: (100, 100, 100, 100), 3: (91, 9, 100, 0), 4: (50, 100, 125, 25), 5: (200, 0, 200, 0)}
    assert got.keys() == expected.keys()
    for key, want in expected.items():
        assert got[key] == pytest.approx(want, abs=1e-6), key


def test_any_shapes_equal_a_raster(spark):
    rng = random.Random(4)
    rows, fine = [], 800
    at = (np.arange(fine) + 0.5) * 40 / fine
    x, y = np.meshgrid(at, at)
    masks = {}
    for key in range(6):
        for part in range(4):
            ring = [[rng.uniform(2, 38), rng.uniform(2, 38)] for _ in range(rng.randint(3, 8))]
            side = "ab"[part % 2]
            rows.append((key, side, part, [ring]))
            inside = np.zeros_like(x, dtype=bool)
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                inside ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay if by != ay else math.inf))
            masks[key, side] = masks.get((key, side), np.zeros_like(inside)) | inside
    cell = (40 / fine) ** 2
    got = areas(spark, rows, 7.0)
    for key in range(6):
        a, b = masks[key, "a"], masks[key, "b"]
        want = [m.sum() * cell for m in (a, b, a | b, a & b)]
        assert got[key] == pytest.approx(want, abs=1.5), key  # at most half a cell along boundaries, whose errors cancel


def test_names(spark):
    parks = spark.createDataFrame([("Elm Park", 1), ("Ash Park", 2), (None, 3)], "name string, id int")
    assert [r.id for r in named(parks, "name", " elm park ").collect()] == [1]
    with pytest.raises(ValueError, match="there are Ash Park, Elm Park"):
        named(parks, "name", "Oak Park")
