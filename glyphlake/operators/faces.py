"""Cells from closed regions of ruled pages (I18 contour_based): the faces that boxes of ink enclose.

A page is cut into slabs at the upper and lower edges of its ink. In a slab ink covers intervals, and what lies between
them is free. Free intervals of neighbouring slabs that overlap are one region; a region that leads to the
page's edge is open, and all others are faces. Slabs are rows, intervals are islands in windows, regions are
components of boxes (I14).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import paged
from .layout import is_cell
from .spatial import hull, largest_component, page_components

#: Cells whose gap is under twice this belong to one table; boxes are the same within so many pixels.
PROXIMITY, SAME = 3, 5
#: By this share of the middle height of cells, at least so many pixels, a cell's middle may be off its row's mean.
ROW_REACH, LEAST_REACH = 0.6, 10.0


def free_intervals(ink: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, box_id (from 0; 0 lies outside), x, y, w, h of the free intervals of the slabs of pages (doc_id, page_w, page_h) with ink (doc_id, x, y, w, h).

    Slabs above and below all ink and a column on either side of the page belong to the outside.
    """
    edges = ink.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.col("y"), F.col("y") + F.col("h")))))).alias("ys"))
    at = lambda edge: F.array_position("ys", edge).cast("int") - 1
    held = ink.join(edges.hint("merge"), "doc_id").where("w > 0 and h > 0").withColumn("slab", F.explode(F.sequence(at(F.col("y")), at(F.col("y") + F.col("h")) - 1)))
    covered = held.select("doc_id", "slab", F.col("x").alias("lo"), (F.col("x") + F.col("w")).alias("hi"))
    slabs = edges.join(pages.hint("merge"), "doc_id").select("doc_id", "ys", "page_w", "page_h", F.explode(F.sequence(F.lit(-1), F.size("ys") - 1)).alias("slab"))
    top = F.when(F.col("slab") < 0, F.least(F.lit(-1), F.get("ys", F.lit(0)) - 1)).otherwise(F.get("ys", F.col("slab")))
    bottom = F.when(F.col("slab") < F.size("ys") - 1, F.get("ys", F.col("slab") + 1)).otherwise(F.greatest(F.col("page_h"), F.get("ys", F.col("slab"))) + 1)
    slabs = slabs.withColumns({"top": top, "bottom": bottom}).drop("ys")
    # ink beyond the page's sides covers them; what is outside goes around it
    sides = slabs.select("doc_id", "slab", F.explode(F.array(F.struct(F.lit(-(2**30)).alias("lo"), F.lit(-1).alias("hi")), F.struct((F.col("page_w") + 1).alias("lo"), F.lit(2**30).alias("hi")))).alias("s")).select("doc_id", "slab", "s.lo", "s.hi")
    inside = covered.select("doc_id", "slab", F.greatest("lo", F.lit(0)).alias("lo"), "hi").join(pages.hint("merge"), "doc_id").select("doc_id", "slab", "lo", F.least("hi", "page_w").alias("hi")).where("lo < hi")
    order = Window.partitionBy("doc_id", "slab").orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = inside.unionByName(sides).withColumn("from", reached).where(F.col("lo") > F.col("from"))
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("slab", "from")) - 1).cast("bigint")
    found = gaps.join(slabs.hint("merge"), ["doc_id", "slab"]).withColumn("box_id", number)
    return found.select("doc_id", "box_id", F.col("from").alias("x"), F.col("top").alias("y"), (F.col("lo") - F.col("from")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"))


def faces(ink: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, x, y, w, h of what surrounds each enclosed region: its box and a pixel of ink on every side."""
    free = free_intervals(ink, pages)
    # a pixel longer, so that an interval overlaps those of the next slab, and of no other
    regions = page_components(free.withColumn("h", F.col("h") + 1), 0)
    closed = free.join(regions.where("component > 0").hint("merge"), ["doc_id", "box_id"])
    boxes = hull(closed, "doc_id", "component")
    return boxes.select("doc_id", *[(F.col(c) + d).cast("int").alias(c) for c, d in (("x", -1), ("y", -1), ("w", 2), ("h", 2))])


def outlines(ink: DataFrame) -> DataFrame:
    """doc_id, x, y, w, h of each group of boxes of ink that touch, corners included."""
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("y", "x", "w", "h")) - 1).cast("bigint")
    numbered = ink.select("doc_id", "x", "y", "w", "h", number.alias("box_id"))
    # grown by half a pixel each, boxes without a gap overlap
    groups = numbered.join(page_components(numbered, 0.5).hint("merge"), ["doc_id", "box_id"])
    return hull(groups, "doc_id", "component").select("doc_id", *[F.col(c).cast("int").alias(c) for c in "xywh"])


def contour_cells(ink: DataFrame, pages: DataFrame, tolerance: int = SAME) -> DataFrame:
    """doc_id, row, col, box_id, x, y, w, h of the cells of pages (doc_id, page_w, page_h) from their ink (doc_id, x, y, w, h).

    Faces and outlines that can be cells (P11), without those around others (J10), once each (A17); rows by
    the running mean of their middles (W01), columns from left to right. All of it is done for whole pages side by
    side (`paged`): by `faces` and `outlines` slabs and intervals moved seven times.
    """
    sizes = pages.select("doc_id", F.col("page_w").cast("double").alias("w"), F.col("page_h").cast("double").alias("h"), F.lit(True).alias("_page"))
    both = ink.select("doc_id", *[F.col(c).cast("double").alias(c) for c in "xywh"], F.lit(False).alias("_page")).unionByName(sizes, allowMissingColumns=True)

    def kernel(table: pa.Table, page: np.ndarray, docs: pa.ChunkedArray) -> pa.Table:
        size = table["_page"].to_numpy()
        x, y, w, h = paged.numbers(table, *"xywh")
        page_w, page_h = np.full(len(docs), np.nan), np.full(len(docs), np.nan)
        page_w[page[size]], page_h[page[size]] = w[size], h[size]
        known = ~size & ~np.isnan(x + y + w + h + page_w[page] + page_h[page])
        found = cells_on_pages(page[known], [c[known] for c in (x, y, w, h)], page_w, page_h, tolerance)
        at = found.pop("page")
        return pa.table({"doc_id": docs.take(pa.array(at)), **{k: pa.array(v.astype(np.int64 if k == "box_id" else np.int32)) for k, v in found.items()}})

    doc = ink.schema["doc_id"].dataType.simpleString()
    return paged.by_page(both, kernel, f"doc_id {doc}, row int, col int, box_id long, x int, y int, w int, h int")


def _hulls(page: np.ndarray, group: np.ndarray, boxes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Page and box around each group, which has a number of its own over all pages."""
    order = np.argsort(group, kind="stable")
    x, y, w, h = (c[order] for c in boxes)
    first = np.flatnonzero(paged.starts_of(group[order]))
    if not len(first):
        return page[:0], [c[:0] for c in boxes]
    left, top = np.minimum.reduceat(x, first), np.minimum.reduceat(y, first)
    return page[order][first], [left, top, np.maximum.reduceat(x + w, first) - left, np.maximum.reduceat(y + h, first) - top]


def _apart(page_w: np.ndarray) -> float:
    """What keeps places of one slab apart from those of the next: more than any page's width and what lies beside it."""
    return float(np.nanmax(page_w, initial=0)) + 8


def _free(page: np.ndarray, ink: list[np.ndarray], page_w: np.ndarray, page_h: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """`free_intervals` on arrays: page, slab (numbers over all pages, of which each leaves one out) and box of the intervals, in order."""
    x, y, w, h = ink
    n = len(page_w)
    ep, ey = np.concatenate([page, page]), np.concatenate([y, y + h])
    order = np.lexsort((ey, ep))
    ep, ey = ep[order], ey[order]
    once = paged.starts_of(ep, ey)
    place = np.empty(len(ep), int)
    place[order] = np.cumsum(once) - 1
    ep, ey = ep[once], ey[once]
    # slab k of an edge lies below it; one more lies above the first edge of a page, and one is left out between pages
    own = paged.numbered(ep)
    slab = np.arange(len(ep)) + 2 * ep + 1
    last = np.append(ep[1:] != ep[:-1], True)[: len(ep)]
    low = np.where(last, np.maximum(page_h[ep], ey) + 1, np.append(ey[1:], 0)[: len(ep)])
    above = own == 0
    sp, sn = np.concatenate([ep, ep[above]]), np.concatenate([slab, slab[above] - 1])
    top, bottom = np.concatenate([ey, np.minimum(-1, ey[above] - 1)]), np.concatenate([low, ey[above]])
    tops, bottoms, owners = (np.zeros(len(ep) + 2 * n + 1) for _ in range(3))
    tops[sn], bottoms[sn], owners[sn] = top, bottom, sp
    # what ink covers of each slab, and what lies beside the page
    drawn = (w > 0) & (h > 0) & (np.maximum(x, 0) < np.minimum(x + w, page_w[page]))
    a, b = place[: len(page)][drawn], place[len(page) :][drawn]
    many = b - a
    of = np.repeat(np.flatnonzero(drawn), many)
    held = np.repeat(slab[a], many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    right = page_w[sp]
    at = np.concatenate([held, sn, sn])
    lo = np.concatenate([np.maximum(x[of], 0), np.full(len(sn), -(2.0**30)), right + 1])
    hi = np.concatenate([np.minimum((x + w)[of], page_w[page[of]]), np.full(len(sn), -1.0), right + 2])
    order = np.lexsort((lo, at))
    at, lo, hi = at[order], lo[order], hi[order]
    # the furthest end before: slabs lie apart from each other by more than any width
    apart = at * _apart(page_w)
    before = (np.concatenate([[-np.inf], np.maximum.accumulate(hi + apart)[:-1]]) - apart)[: len(at)]
    gap = (lo > before) & ~paged.starts_of(at)
    at, lo, before = at[gap], lo[gap], before[gap]
    return owners[at].astype(int), at, [before, tops[at], lo - before, bottoms[at] - tops[at]]


def cells_on_pages(page: np.ndarray, ink: list[np.ndarray], page_w: np.ndarray, page_h: np.ndarray, tolerance: int) -> dict[str, np.ndarray]:
    """I18 on arrays: page, row, col, box_id, x, y, w, h of the cells of pages from their ink (page, and x, y, w, h); the steps are those of the functions above."""
    fp, slab, free = _free(page, ink, page_w, page_h)
    # regions: intervals of neighbouring slabs that overlap; those of a slab are in order and apart
    apart = _apart(page_w)
    start, end = free[0] + slab * apart, free[0] + free[2] + slab * apart
    first = np.searchsorted(end, start + apart, "right")
    many = np.maximum(np.searchsorted(start, end + apart, "left") - first, 0)
    a = np.repeat(np.arange(len(fp)), many)
    region = paged.components(len(fp), a, np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(a)))
    outside = np.flatnonzero(paged.starts_of(fp))[np.cumsum(paged.starts_of(fp)) - 1] if len(fp) else region
    closed = region != outside
    p, (x, y, w, h) = _hulls(fp[closed], region[closed], [c[closed] for c in free])
    # outlines: boxes of ink that touch
    edges = paged.sides(*ink)
    pairs = [(np.zeros(0, int), np.zeros(0, int))]
    for i, j in paged.near(page, edges):
        met = (edges[0][i] < edges[1][j] + 1) & (edges[0][j] < edges[1][i] + 1) & (edges[2][i] < edges[3][j] + 1) & (edges[2][j] < edges[3][i] + 1)
        pairs.append((i[met], j[met]))
    q, solid = _hulls(page, paged.components(len(page), *(np.concatenate(c) for c in zip(*pairs, strict=True))), ink)
    p = np.concatenate([p, q])
    x, y, w, h = (np.concatenate(c) for c in zip((x - 1, y - 1, w + 2, h + 2), solid, strict=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = is_cell(w, h, page_w[p], page_h[p])
    p, x, y, w, h = (c[fit] for c in (p, x, y, w, h))
    order = np.lexsort((h, w, x, y, p))
    p, x, y, w, h = (c[order] for c in (p, x, y, w, h))
    number = paged.numbered(p)
    # Without those around others
    inner = np.ones(len(p), bool)
    boxes = paged.sides(x, y, w, h)
    for i, j in paged.near(p, boxes):
        for a, b in ((i, j), (j, i)):
            around = (boxes[0][a] <= boxes[0][b]) & (boxes[2][a] <= boxes[2][b]) & (boxes[1][a] >= boxes[1][b]) & (boxes[3][a] >= boxes[3][b])
            inner[a[around]] = False
    p, x, y, w, h, number = (c[inner] for c in (p, x, y, w, h, number))
    # Once each
    keys = [np.rint(c / float(tolerance)) for c in (x, y, w, h)]
    order = np.lexsort((number, *keys, p))
    single = np.sort(order[paged.starts_of(p[order], *[k[order] for k in keys])])
    p, x, y, w, h, number = (c[single] for c in (p, x, y, w, h, number))
    # Rows, and columns from left to right
    own = np.cumsum(paged.starts_of(p)) - 1
    reach = np.maximum(LEAST_REACH, ROW_REACH * paged.medians(own, h)[own]) if len(p) else h
    order, row = paged.mean_groups(p, y + h / 2, number, reach)
    p, x, y, w, h, number = (c[order] for c in (p, x, y, w, h, number))
    order = np.lexsort((number, y, x + w / 2, row, p))
    p, x, y, w, h, number, row = (c[order] for c in (p, x, y, w, h, number, row))
    return {"page": p, "row": row, "col": paged.numbered(p, row), "box_id": number, "x": x, "y": y, "w": w, "h": h}


def table_bounds(cells: DataFrame, proximity: int = PROXIMITY) -> DataFrame:
    """doc_id, x, y, w, h around the largest group of cells (doc_id, box_id, x, y, w, h) that lie near each other."""
    groups = page_components(cells, proximity)
    table = largest_component(groups).select("doc_id", "component")
    return hull(cells.join(groups.join(table.hint("merge"), ["doc_id", "component"]).hint("merge"), ["doc_id", "box_id"]), "doc_id")
