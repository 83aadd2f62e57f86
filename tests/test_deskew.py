"""Tilts of ruled pages, and where boxes are once a page is level."""

import math

from pyspark.sql import functions as F

from glyphlake.operators import deskew
from glyphlake.plans.flows import tilted_runs


def test_angles(spark):
    angles = [-19.9, -12.34, -3.07, -1.0, -0.4, -0.16, 0.0, 0.04, 0.13, 0.3, 0.55, 1.5, 7.77, 19.5, 21.0, -33.0]
    pages = spark.createDataFrame([(i, a, False) for i, a in enumerate(angles)] + [(99, 3.0, True)], "doc_id long, a double, bare boolean")
    found = {r["doc_id"]: r for r in deskew.tilts(tilted_runs(pages), pages).collect()}
    for i, a in enumerate(angles):
        assert abs(found[i]["angle"] - a) < 0.1, (a, found[i])
        assert found[i]["n"] >= 4
        assert found[i]["skipped"] == ("too_large" if abs(a) > 20 else "level" if abs(a) < 0.1 else None)
    assert (found[99]["n"], found[99]["angle"], found[99]["skipped"]) == (0, 0.0, "no_lines")
    assert deskew.tilts(tilted_runs(pages.limit(0)), pages.limit(0)).count() == 0


def test_levelled(spark):
    pages = spark.createDataFrame([(1, 800, 600), (2, 800, 600)], "doc_id long, page_w int, page_h int")
    found = spark.createDataFrame([(1, 10.0, None), (2, 0.02, "level")], "doc_id long, angle double, skipped string")
    boxes = spark.createDataFrame([(1, 7, 100, 50, 40, 20), (2, 8, 1, 2, 3, 4)], "doc_id long, box_id long, x int, y int, w int, h int")
    got = {r["doc_id"]: r for r in deskew.levelled(boxes, found, pages).collect()}
    c, s = math.cos(math.radians(10)), math.sin(math.radians(10))
    wide, high = math.floor(600 * s + 800 * c), math.floor(600 * c + 800 * s)
    points = [(c * (x - 400) + s * (y - 300) + wide / 2, -s * (x - 400) + c * (y - 300) + high / 2) for x in (100, 140) for y in (50, 70)]
    left, top = math.floor(min(p[0] for p in points)), math.floor(min(p[1] for p in points))
    assert (got[1]["x"], got[1]["y"], got[1]["box_id"]) == (left, top, 7)
    assert (got[1]["w"], got[1]["h"]) == (math.ceil(max(p[0] for p in points)) - left, math.ceil(max(p[1] for p in points)) - top)
    assert tuple(got[2]) == (2, 8, 1, 2, 3, 4)
    assert deskew.levelled(boxes, found, pages).where(F.col("box_id").isNull()).count() == 0


def test_level_rules_beside_writing(spark):
    # a long run is gathered at its own degree alone, so short runs of writing near it don't turn the page; failed before
    pages = spark.createDataFrame([(i, 0.0, False) for i in (152, 274, 823)], "doc_id long, a double, bare boolean")
    assert [r["skipped"] for r in deskew.tilts(tilted_runs(pages), pages).collect()] == ["level"] * 3


def test_votes_stay_in_their_task(spark):
    # 182 rows for each run went into a shuffle before
    pages = spark.createDataFrame([(1, 3.0, False)], "doc_id long, a double, bare boolean")
    plan = deskew.segments(tilted_runs(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert "-45" not in plan and "MapInArrow" in plan
