"""Pages in photos: least rectangles against a search over angles, homographies by their corners."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.functions.geometry import apply_matrix
from glyphlake.operators import perspective

PAGES, POINTS = "doc_id long, page_w int, page_h int", "doc_id long, x double, y double"


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_least_rectangle(n):
    rng = random.Random(n)
    for _ in range(20):
        x, y = (np.array([rng.choice([rng.randint(0, 9), rng.uniform(0, 30)]) for _ in range(n)]) for _ in "xy")
        corners = perspective.least_rectangle(x, y)
        sides = np.hypot(*(np.roll(corners, -1, axis=0) - corners).T)
        area = sides[0] * sides[1]
        for degree in np.arange(0, 90, 0.5):
            c, s = math.cos(math.radians(degree)), math.sin(math.radians(degree))
            assert area <= np.ptp(c * x + s * y) * np.ptp(c * y - s * x) + 1e-6
        middle = corners.mean(axis=0)
        for a, b in zip(x, y, strict=True):  # every point lies inside
            for k in (0, 1):
                side = corners[k + 1] - corners[k]
                if sides[k] > 1e-9:
                    assert abs(np.dot([a, b] - middle, side) / sides[k]) <= sides[k] / 2 + 1e-6


def test_any_quad(spark):
    """The matrix takes four corners, whatever their perspective, to those of the page."""
    rng = random.Random(2)
    rows = [(i, [(rng.uniform(0, 99), rng.uniform(0, 99)), (rng.uniform(300, 400), rng.uniform(0, 99)), (rng.uniform(300, 400), rng.uniform(300, 500)), (rng.uniform(0, 99), rng.uniform(300, 500))], 200 + i, 300 + i) for i in range(20)]
    rows.append((99, [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0), (30.0, 0.0)], 9, 9))
    frame = spark.createDataFrame(rows, "id int, corners array<struct<x:double,y:double>>, w int, h int").withColumn("m", perspective.quad_matrix(F.col("corners"), F.col("w"), F.col("h")))
    to = F.array(*[apply_matrix(F.col("m"), F.get("corners", F.lit(i))["x"], F.get("corners", F.lit(i))["y"]) for i in range(4)])
    for r in frame.select("id", "w", "h", "m", to.alias("to")).collect():
        if r["id"] == 99:
            assert r["m"] is None
            continue
        want = [(0, 0), (r["w"] - 1, 0), (r["w"] - 1, r["h"] - 1), (0, r["h"] - 1)]
        assert np.allclose([(p["x"], p["y"]) for p in r["to"]], want, atol=1e-6)


def test_pages(spark):
    """A page on a desk is cut out; a word, a line and nothing at all leave the photo as it is."""
    outline = [(1, *p) for p in ((70, 90), (930, 90), (930, 1310), (70, 1310), (500, 400))] + [(2, *p) for p in ((80, 100), (117, 100), (117, 157), (80, 157))] + [(3, *p) for p in ((5, 5), (500, 5))]
    found = perspective.page_quads(spark.createDataFrame([(d, float(x), float(y)) for d, x, y in outline], POINTS), spark.createDataFrame([(d, 1000, 1400) for d in (1, 2, 3, 4)], PAGES))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert (rows[1]["w"], rows[1]["h"], rows[1]["skipped"]) == (860, 1220, None)
    assert {d: rows[d]["skipped"] for d in (2, 3, 4)} == {2: "too_small", 3: "degenerate", 4: "no_outline"} and all(rows[d]["matrix"] is None for d in (2, 3, 4))
    boxes = spark.createDataFrame([(1, 7, 170, 190, 86, 122), (2, 8, 1, 2, 3, 4)], "doc_id long, box_id long, x int, y int, w int, h int")
    moved = {r["doc_id"]: tuple(r) for r in perspective.straightened(boxes, found).collect()}
    assert moved[2] == (2, 8, 1, 2, 3, 4)
    assert moved[1][:2] == (1, 7) and all(abs(a - b) <= 1 for a, b in zip(moved[1][2:], (100, 100, 86, 122), strict=True))
