"""Joins of boxes by tiles: against all pairs in plain Python, and on a page of 100,000 boxes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import spatial

BOX = "doc_id long, box_id long, x int, y int, w int, h int"


def pages(seed, n=70):
    rng = random.Random(seed)
    rows = []
    for d in range(4):
        for i in range(n if d else 3):
            big = rng.random() < 0.1
            rows.append((d, i, rng.randint(-60, 300), rng.randint(0, 300), rng.randint(0, 250 if big else 30), rng.randint(0, 250 if big else 12)))
        rows.append((d, n, *rows[-1][2:]))  # an equal box
    return rows


def over(a, b, m=0):
    return a[2] - m < b[2] + b[4] + m and b[2] - m < a[2] + a[4] + m and a[3] - m < b[3] + b[5] + m and b[3] - m < a[3] + a[5] + m


def inside(b, a):
    return a[2] <= b[2] and a[3] <= b[3] and a[2] + a[4] >= b[2] + b[4] and a[3] + a[5] >= b[3] + b[5]


@pytest.mark.parametrize("per_tile", [2, 32, 10**6])
def test_as_all_pairs(spark, monkeypatch, per_tile):
    monkeypatch.setattr(spatial, "PER_TILE", per_tile)
    rows = pages(per_tile)
    frame = spark.createDataFrame(rows, BOX).repartition(3)
    same = [(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1]]
    ids = lambda df: sorted((r["doc_id"], r["box_id"]) for r in df.collect())
    every = sorted(r[:2] for r in rows)
    hit = {a[:2] for a, b in same if inside(b, a)}
    assert ids(spatial.innermost(frame)) == [k for k in every if k not in hit]
    for margin in (0, 1, 3):
        edges = sorted(tuple(r) for r in spatial.overlap_edges(frame, margin).collect())
        assert edges == sorted((a[0], a[1], b[1]) for a, b in same if a[1] < b[1] and over(a, b, margin))
    axis = lambda r: "h" if r[1] % 2 else "v"
    near = lambda a, b: a[2] - 3 <= b[2] + b[4] and b[2] <= a[2] + a[4] + 3 and a[3] - 3 <= b[3] + b[5] and b[3] <= a[3] + a[5] + 3
    lines = frame.withColumnRenamed("box_id", "line_id").withColumn("axis", F.when(F.col("line_id") % 2 == 1, "h").otherwise("v"))
    want = {a[:2] for a, b in same if axis(a) != axis(b) and near(a, b)}
    assert sorted((r["doc_id"], r["line_id"]) for r in spatial.crossing_lines(lines).collect()) == sorted(want)
    blobs = frame.withColumn("cluster", F.col("box_id") % 5).drop("y", "h")
    want = {a[:2] for a, b in same if a[1] % 5 == b[1] % 5 and min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]) >= 0.5 * min(a[4], b[4])}
    assert ids(spatial.stacked_overlap(blobs)) == sorted(want)
    rules = [(d, 50 * i, 0, 2, 200) for d in range(3) for i in range(5)]
    want = {a[:2] for a in rows for r in rules if a[0] == r[0] and over(a, (0, 0, *r[1:]))}
    assert ids(spatial.crossing_rules(frame, spark.createDataFrame(rules, "doc_id long, x int, y int, w int, h int"))) == sorted(want)
    assert spatial.overlap_edges(frame.limit(0)).count() == spatial.innermost(frame.limit(0)).count() == 0


def test_gaps(spark):
    """Both boxes grow: with a margin of 1, boxes with a gap of 1 overlap, with a gap of 2 they touch and don't."""
    rows = [(gap, i, i * (10 + gap), 0, 10, 10) for gap in (0, 1, 2) for i in range(2)]
    frame = spark.createDataFrame(rows, BOX)
    assert sorted(r["doc_id"] for r in spatial.overlap_edges(frame, 1).collect()) == [0, 1]
    assert {r["doc_id"]: r["n"] for r in spatial.largest_component(spatial.page_components(frame, 1)).collect()} == {0: 2, 1: 2, 2: 1}
    assert {r["doc_id"]: r["n"] for r in spatial.largest_component(spatial.page_components(frame, 3)).collect()} == {0: 2, 1: 2, 2: 2}


def test_a_crowded_page(spark):
    """100,000 boxes of one page, a box around each 50th and one around all: seconds, not ten thousand million pairs."""
    n = 100_000
    small = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("box_id"), (F.col("id") % 400 * 10).cast("int").alias("x"), F.floor(F.col("id") / 400).cast("int").alias("y0"))
    small = small.select("doc_id", "box_id", "x", (F.col("y0") * 10).alias("y"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    outer = small.where("box_id % 50 = 0").select("doc_id", (F.col("box_id") + n).alias("box_id"), (F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"))
    whole = spark.createDataFrame([(1, 9 * n, -5, -5, 5000, 5000)], BOX)
    page = small.unionByName(outer).unionByName(whole)
    start = time.time()
    assert spatial.innermost(page).count() == n
    assert spatial.overlap_edges(page, 0).count() == n // 50 + n + n // 50
    assert spatial.crossing_lines(page.select("doc_id", F.col("box_id").alias("line_id"), F.when(F.col("box_id") < n, "h").otherwise("v").alias("axis"), "x", "y", "w", "h"), 0).count() == n + n // 50 + 1
    assert spatial.crossing_rules(page, outer).count() >= n // 50
    fragments = small.select("doc_id", F.col("box_id").alias("frag_id"), F.lit(None).cast("string").alias("source_id"), "x", "y", "w", "h")
    regions = small.select("doc_id", F.col("box_id").cast("string").alias("region_id"), F.col("box_id").alias("ord"), "x", "y", "w", "h")
    assert spatial.best_region(fragments, regions).where("frag_id = region_id").count() == n
    assert spatial.stacked_overlap(small.withColumn("cluster", F.lit(1)).where("y < 1000 and x % 40 = 0").select("doc_id", "cluster", "box_id", (F.col("y") * 400 + F.col("x")).alias("x"), "w")).count() == 0
    assert time.time() - start < 240
