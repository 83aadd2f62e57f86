"""Faces that ink encloses, against a flood fill of pixels."""

import random

import pytest

from glyphlake.operators import faces

W, H = 60, 48
INK, PAGES = "doc_id long, x int, y int, w int, h int", "doc_id long, page_w int, page_h int"


def filled(cells, steps):
    """Groups of cells that neighbouring cells lead to."""
    left, groups = set(cells), []
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x, y = todo.pop()
            for dx, dy in steps:
                if (x + dx, y + dy) in left:
                    left.discard((x + dx, y + dy))
                    group.add((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
        groups.append(group)
    return groups


def bounds(group, pad=0):
    xs, ys = [p[0] for p in group], [p[1] for p in group]
    return min(xs) - pad, min(ys) - pad, max(xs) - min(xs) + 1 + 2 * pad, max(ys) - min(ys) + 1 + 2 * pad


def pixels(boxes):
    return {(i, j) for x, y, w, h in boxes for i in range(x, x + w) for j in range(y, y + h)}


@pytest.mark.parametrize("seed", [1, 2])
def test_as_flood_fill(spark, seed):
    rng = random.Random(seed)
    pages = {}
    for d in range(12):
        boxes = [(rng.randint(0, 40), rng.randint(0, 40), w, h) for w, h in [(rng.randint(4, 20), rng.randint(1, 2)) if rng.random() < 0.5 else (rng.randint(1, 2), rng.randint(4, 20)) for _ in range(rng.choice([3, 25, 60]))]]
        pages[d] = [(x, y, min(w, W - x), min(h, H - y)) for x, y, w, h in boxes]
    ink = spark.createDataFrame([(d, *b) for d, boxes in pages.items() for b in boxes], INK)
    sizes = spark.createDataFrame([(d, W, H) for d in range(13)], PAGES)
    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    want, solid = [], []
    for d, boxes in pages.items():
        drawn = pixels(boxes)
        free = {(i, j) for i in range(-1, W + 1) for j in range(-1, H + 1)} - drawn
        want += [(d, *bounds(g, 1)) for g in filled(free, four) if (-1, -1) not in g]
        solid += [(d, *bounds(g)) for g in filled(drawn, [*four, (1, 1), (1, -1), (-1, 1), (-1, -1)])]
    assert sorted(tuple(r) for r in faces.faces(ink, sizes).collect()) == sorted(want)
    assert len(want) > 20
    assert sorted(tuple(r) for r in faces.outlines(ink).collect()) == sorted(solid)


def grid(d, x0, y0, rows, cols, w=160, h=70):
    across = [(d, x0 - 1, y0 + r * h - 1, cols * w + 3, 3) for r in range(rows + 1)]
    return across + [(d, x0 + c * w - 1, y0 - 1, 3, rows * h + 3) for c in range(cols + 1)]


def test_cells_and_table(spark):
    """A clean grid has all of its cells, indexed from the top and from the left; the largest group of cells is the table."""
    ink = spark.createDataFrame(grid(1, 80, 120, 4, 3) + grid(2, 80, 40, 1, 2) + grid(2, 60, 300, 3, 4, 120, 50), INK)
    cells = faces.contour_cells(ink, spark.createDataFrame([(1, 800, 700), (2, 800, 700), (3, 800, 700)], PAGES)).cache()
    one = sorted((r["row"], r["col"], r["x"], r["y"]) for r in cells.where("doc_id = 1").collect())
    assert [x[:2] for x in one] == [(r, c) for r in range(4) for c in range(3)]
    assert [x[2:] for x in one] == [(81 + 160 * c, 121 + 70 * r) for r in range(4) for c in range(3)]
    assert cells.where("doc_id = 2").count() == 2 + 12 and cells.where("doc_id = 3").count() == 0
    table = {r["doc_id"]: (r["x"], r["y"], r["w"], r["h"]) for r in faces.table_bounds(cells).collect()}
    assert table == {1: (81, 121, 479, 279), 2: (61, 301, 479, 149)}
    cells.unpersist()


def test_no_ink(spark):
    none = spark.createDataFrame([], INK)
    assert faces.contour_cells(none, spark.createDataFrame([(1, 800, 700)], PAGES)).count() == 0


def test_cells_are_not_broadcast(spark):
    # by the size of files slabs and intervals seemed small, and went whole through the driver
    from glyphlake.plans import flows

    plan = flows.i18_contour_cells(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
