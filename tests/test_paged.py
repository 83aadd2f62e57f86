"""Steps on all rows of a page at once: against plain Python, on crowded pages, and their plans (findings of round 5)."""

import random
import statistics
import time

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphlake.operators import cluster, faces, forms, grids, layout, paged, spatial
from glyphlake.plans import flows, invoices

DATA = "/root/testdata/sf0.001"


def plan_of(query, spark):
    return query(spark, DATA)._jdf.queryExecution().executedPlan().toString()


def not_writing(blobs, rules):
    """I13, blob by blob: ids that stay."""
    out, todo = set(), sorted(blobs, key=lambda b: (b[2] + b[4] / 2, b[0]))
    while todo:
        own = [todo.pop(0)]
        while todo and todo[0][2] + todo[0][4] / 2 - own[-1][2] - own[-1][4] / 2 <= 25:
            own.append(todo.pop(0))
        median = statistics.median(b[3] for b in own)
        over = lambda a, b: min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]) >= 0.5 * min(a[3], b[3])
        lines = [a for a in own if abs(a[3] - median) / max(median, 1) <= 0.35 and any(over(a, b) for b in own if b is not a)]
        for i, x, y, w, h in own:
            top = int(y + h / 2) - 4
            crossed = any(x < rx + rw and rx < x + w and top < ry + rh and ry < top + 9 for rx, ry, rw, rh in rules)
            if len(lines) < 2 or crossed:
                out.add(i)
    return out


def test_writing_as_blob_by_blob(spark, monkeypatch):
    rng = random.Random(5)
    blobs, rules, want = [], [], []
    for d in [*range(40), None]:
        own = [(i, rng.randint(0, 300), rng.randint(0, 900), rng.choice([0, 40, 60, 200]), rng.randint(1, 9)) for i in range(rng.choice([1, 8, 40]))]
        up = [(rng.randint(0, 400), rng.randint(0, 800), 2, rng.randint(0, 90)) for _ in range(rng.choice([0, 9]))]
        blobs += [(d, *b, f"b{b[0]}") for b in own]
        rules += [(d, *r) for r in up]
        want += [(d, i, f"b{i}") for i in not_writing(own, up)]
    box = "x int, y int, w int, h int"
    monkeypatch.setattr(paged, "ROWS", 50)  # pages end within what is handed on
    got = grids.without_stacked_text(spark.createDataFrame(blobs, f"doc_id long, box_id long, {box}, name string"), spark.createDataFrame(rules, f"doc_id long, {box}"))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.select("doc_id", "box_id", "name").collect()), key=key) == sorted(want, key=key)
    assert 0 < len(want) < len(blobs)


def test_writing_is_judged_in_one_step(spark):
    # five groups and windows, each with a sort of all blobs; 3,600,000 lines weren't done in 150 s
    plan = plan_of(invoices.i13_stacked_writing, spark)
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 1


def test_crowded_cluster():
    # a hundred thousand blobs above each other, no pair for pair
    n, began = 100_000, time.time()
    assert paged.stacked(np.zeros(n, int), np.arange(n), np.zeros(n), np.full(n, 80.0)).all() and time.time() - began < 5


def ruled(rng, d):
    """Blobs of a page with rules in pieces, some missing, and others anywhere."""
    xs, ys = sorted(rng.sample(range(20, 600, 5), rng.randint(0, 6))), sorted(rng.sample(range(20, 500, 5), rng.randint(0, 7)))
    out = [("v", x + rng.randint(-2, 2), a + rng.randint(-4, 8), rng.randint(1, 3), b - a + rng.randint(-8, 4)) for x in xs for a, b in zip(ys, ys[1:], strict=False) if rng.random() < 0.75]
    out += [("h", a + rng.randint(-4, 8), y + rng.randint(-2, 2), b - a + rng.randint(-8, 4), rng.randint(1, 3)) for y in ys for a, b in zip(xs, xs[1:], strict=False) if rng.random() < 0.75]
    out += [("v", x, ys[0], 3, ys[-1] - ys[0]) for x in xs if ys and rng.random() < 0.5] + [("h", xs[0], y, xs[-1] - xs[0], 3) for y in ys if xs and rng.random() < 0.5]
    out += [(rng.choice("hhv"), rng.randint(0, 600), rng.randint(0, 500), rng.randint(1, 100), rng.randint(1, 60)) for _ in range(rng.randint(0, 6))]
    return [(d, axis, k, *box) for k, (axis, *box) in enumerate(out)]


def test_grid_cells_as_step_by_step(spark, monkeypatch):
    rng = random.Random(7)
    rows = [r for d in range(80) for r in ruled(rng, d)]
    blobs = spark.createDataFrame(rows, "doc_id long, axis string, box_id long, x int, y int, w int, h int")
    monkeypatch.setattr(paged, "ROWS", 500)
    upright, flat = blobs.where("axis = 'v'"), blobs.where("axis = 'h'")
    clean = grids.without_stacked_text(flat, upright).unionByName(upright)
    want = grids.cells_of(grids.extended(grids.meeting(grids.rule_lines(clean))), clean)
    got = grids.grid_cells(blobs)
    assert got.schema.simpleString() == want.schema.simpleString()
    want = sorted(str(tuple(r)) for r in want.collect())
    assert sorted(str(tuple(r)) for r in got.collect()) == want and len(want) > 100
    # a page without a number is a page; its ink met no place in a join
    whole = blobs.groupBy("doc_id").count().orderBy(F.desc("count")).first()["doc_id"]
    lost = grids.grid_cells(blobs.where(F.col("doc_id") == whole).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(tuple(r)[1:] for r in lost.collect()) == sorted(tuple(r)[1:] for r in got.where(F.col("doc_id") == whole).collect())


def test_grid_cells_are_found_in_one_step(spark):
    # 45 windows, groups and joins; 900,000 pages weren't done in 150 s
    plan = plan_of(flows.i18_grid_cells, spark)
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1


def contour_cells(ink, pages):
    """I18 by the operators it is made of, one after the other."""
    closed = faces.faces(ink, pages).unionByName(faces.outlines(ink)).join(pages, "doc_id")
    fit = closed.where(layout.is_cell(F.col("w"), F.col("h"), F.col("page_w"), F.col("page_h")))
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("y", "x", "w", "h")) - 1).cast("bigint")
    cells = spatial.quantised_distinct(spatial.innermost(fit.select("doc_id", number.alias("box_id"), "x", "y", "w", "h")), 5)
    rows = cluster.mean_clusters(cells.withColumn("cy", F.col("y") + F.col("h") / 2), ["doc_id"], "cy", "box_id", F.greatest(F.lit(10.0), 0.6 * F.median("h")), ("x", "y", "w", "h"))
    col = F.row_number().over(Window.partitionBy("doc_id", "cluster").orderBy(F.col("x") + F.col("w") / 2, "y", "id")) - 1
    return rows.select("doc_id", F.col("cluster").alias("row"), col.cast("int").alias("col"), F.col("id").alias("box_id"), "x", "y", "w", "h")


def test_contour_cells_as_step_by_step(spark, monkeypatch):
    rng = random.Random(3)
    ink = [(d, x - 20, y - 20, w + 3, h + 3) for d in range(60) for _, _, _, x, y, w, h in ruled(rng, d)]
    ink += [(d, rng.randint(-30, 580), rng.randint(-30, 480), rng.choice([0, 30, 90]), rng.choice([0, 25, 60])) for d in range(60) for _ in range(rng.randint(0, 4))]
    ink += [(70, 10, 10, 50, 50), (None, 10, 10, 50, 50)]  # pages without a size
    box = spark.createDataFrame(ink, "doc_id long, x int, y int, w int, h int")
    pages = spark.createDataFrame([(d, 560, rng.choice([0, 460])) for d in range(62)], "doc_id long, page_w int, page_h int")
    monkeypatch.setattr(paged, "ROWS", 300)
    want, got = contour_cells(box, pages), faces.contour_cells(box, pages)
    assert got.schema.simpleString() == want.schema.simpleString()
    want = sorted(tuple(r) for r in want.collect())
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 60


def test_contour_cells_are_found_in_one_step(spark):
    # slabs, intervals and boxes were written to disk for each of their joins: 2,877 MB for 900,000 pages
    plan = plan_of(flows.i18_contour_cells, spark)
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM")


def test_form_labels_are_found_in_one_step(spark):
    # twenty windows, each with a sort of all cells; 3,600,000 lines weren't done in 150 s
    plan = plan_of(invoices.r20_form_labels, spark)
    assert "Join" not in plan and plan.count("MapInArrow") == 1 and plan.count("Window [") <= 3


def test_form_without_a_known_table(spark):
    """Cells of a page without a table go, those of one without bounds lie in no zone."""
    row = [(100 * c, 300) for c in range(6)]
    cells = [(d, k, x, y, 80, 20) for d in (1, 2, 3) for k, (x, y) in enumerate([*row, *((x, y + 40) for x, y in row), (10, 100)])]
    frame = spark.createDataFrame(cells, "doc_id long, cell_id long, x int, y int, w int, h int")
    tables = spark.createDataFrame([(1, 290, 400), (2, None, 400)], "doc_id long, top int, bottom int")
    got = {(r["doc_id"], r["cell_id"]): (r["zone"], r["role"]) for r in forms.label_form(frame, tables).collect()}
    assert len(got) == 26 and {got[2, k] for k in range(13)} == {("unknown", "unknown")} and got[1, 12] == ("header", "invoice_number")
    assert [got[1, k] for k in (0, 5, 6, 11)] == [("table", "column_header"), ("table", "column_header"), ("table", "notes"), ("table", "line_number")]
