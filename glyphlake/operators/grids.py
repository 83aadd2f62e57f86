"""Tables from ruled lines, with blobs of ink as rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paged
from .cluster import gap_clusters
from .spatial import crossing_lines

MIN_LENGTH, FLATTEN_GAP, MERGE_GAP, STACK_GAP = 40, 10, 15, 25
SIMILAR, STACKED, CROSSING, BAND = 0.35, 2, 4, 3
COVERAGE, EXTENT, MIN_CELL, MEETING = 0.5, 0.5, 10, 15


def without_stacked_text(blobs: DataFrame, rules: DataFrame) -> DataFrame:
    """Horizontal blobs (doc_id, box_id, x, y, w, h) that aren't lines of writing; rules (doc_id, x, y, w, h) are the vertical ones.

    Blobs whose middles follow each other within STACK_GAP form a cluster. A cluster is writing if STACKED of its
    members or more are about as long as its median and lie above another member; its blobs go, but for those
    that a rule crosses. Pages are judged by `paged`: one sort of their blobs and rules instead of five groups.
    """
    box = lambda rows: rows.select("doc_id", *[F.col(c).cast("double").alias(f"_{c}") for c in "xywh"])
    whole = blobs.select(*blobs.columns, *[F.col(c).cast("double").alias(f"_{c}") for c in "xywh"], F.lit(False).alias("_rule"))
    both = whole.unionByName(box(rules).withColumn("_rule", F.lit(True)), allowMissingColumns=True)
    names = blobs.columns

    def kernel(table: pa.Table, page: np.ndarray, docs: pa.ChunkedArray) -> pa.Table:
        rule = table["_rule"].to_numpy()
        at = np.flatnonzero(~rule)
        boxes = paged.numbers(table, "_x", "_y", "_w", "_h")
        ids = table["box_id"].take(pa.array(at)).to_numpy()
        kept = not_writing(page[at], ids, [c[at] for c in boxes], page[rule], [c[rule] for c in boxes])
        return table.select(names).take(pa.array(at[kept]))

    return paged.by_page(both, kernel, blobs.schema)


def not_writing(page: np.ndarray, ids: np.ndarray, boxes: list[np.ndarray], rule_page: np.ndarray, rules: list[np.ndarray]) -> np.ndarray:
    """I13 on arrays: whether a horizontal blob (page, box_id, and x, y, w, h) stays, beside the vertical ones of rules."""
    x, y, w, h = boxes
    order, cluster = paged.gap_groups(page, y + h / 2, ids, STACK_GAP)
    median = paged.medians(cluster, w[order])[cluster] if len(order) else np.zeros(0)
    alike = np.abs(w[order] - median) / np.fmax(median, 1) <= SIMILAR
    lines = alike & paged.stacked(cluster, ids[order], x[order], w[order])
    kept = np.ones(len(order), bool)
    kept[order] = (np.bincount(cluster, lines) < STACKED)[cluster] if len(order) else True
    # of writing, what a rule crosses stays
    lost = np.flatnonzero(~kept)
    band = paged.sides(x[lost], np.floor(y[lost] + h[lost] / 2) - CROSSING, w[lost], np.full(len(lost), 2.0 * CROSSING + 1))
    rule = paged.sides(*rules)
    for i, j in paged.meeting(page[lost], band, rule_page, rule):
        met = (band[0][i] < rule[1][j]) & (rule[0][j] < band[1][i]) & (band[2][i] < rule[3][j]) & (rule[2][j] < band[3][i])
        kept[lost[i[met]]] = True
    return kept


def _flattened(lines: DataFrame, gap: int) -> DataFrame:
    """Lines (doc_id, axis, line_id, pos, lo, hi) of one axis that follow each other within gap, as one: mean place, whole extent."""
    grouped = gap_clusters(lines, ["doc_id", "axis"], "pos", "line_id", F.lit(gap)).groupBy("doc_id", "axis", "cluster")
    return grouped.agg(F.floor(F.avg("pos")).cast("int").alias("pos"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumnRenamed("cluster", "line_id")


def rule_lines(blobs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, axis, line_id, pos, lo, hi of rules from blobs (doc_id, axis h or v, box_id, x, y, w, h); short ones go, near ones are one."""
    along = F.col("axis") == "h"
    long = blobs.where(F.when(along, F.col("w")).otherwise(F.col("h")) >= min_length)
    lines = long.select(
        "doc_id", "axis", F.col("box_id").alias("line_id"), F.when(along, F.col("y") + F.floor(F.col("h") / 2)).otherwise(F.col("x") + F.floor(F.col("w") / 2)).cast("int").alias("pos"),
        F.when(along, F.col("x")).otherwise(F.col("y")).alias("lo"), F.when(along, F.col("x") + F.col("w")).otherwise(F.col("y") + F.col("h")).alias("hi"),
    )
    return _flattened(_flattened(lines, FLATTEN_GAP), MERGE_GAP)


def meeting(lines: DataFrame, tolerance: int = MEETING) -> DataFrame:
    """Lines that meet one of the other axis."""
    along = F.col("axis") == "h"
    span = F.col("hi") - F.col("lo")
    boxed = lines.withColumns({"x": F.when(along, F.col("lo")).otherwise(F.col("pos")), "y": F.when(along, F.col("pos")).otherwise(F.col("lo")), "w": F.when(along, span).otherwise(0), "h": F.when(along, 0).otherwise(span)})
    return crossing_lines(boxed, tolerance).select(*lines.columns)


def extended(lines: DataFrame, share: float = EXTENT) -> DataFrame:
    """Lines drawn out to the table's bounds; those that cover less than a share of it go. Pages with one axis alone stay."""
    page, along = Window.partitionBy("doc_id"), F.col("axis") == "h"
    edge = lambda pick, h, v: pick(F.when(along, F.col(h)).otherwise(F.col(v))).over(page)
    bounds = lines.withColumns(
        {"_x1": edge(F.min, "lo", "pos"), "_x2": edge(F.max, "hi", "pos"), "_y1": edge(F.min, "pos", "lo"), "_y2": edge(F.max, "pos", "hi"), "_axes": F.size(F.collect_set("axis").over(page))}
    )
    first, last = F.when(along, F.col("_x1")).otherwise(F.col("_y1")), F.when(along, F.col("_x2")).otherwise(F.col("_y2"))
    both = F.col("_axes") == 2
    kept = bounds.where(~both | (F.col("hi") - F.col("lo") >= share * F.greatest(last - first, F.lit(1))))
    return kept.withColumns({"lo": F.when(both, first).otherwise(F.col("lo")), "hi": F.when(both, last).otherwise(F.col("hi"))}).select(*lines.columns)


def _covered(spans: Column) -> Column:
    """How much sorted spans (lo, hi) cover together."""
    start = F.struct(F.lit(-(2**31)).cast("long").alias("at"), F.lit(0).cast("long").alias("sum"))
    step = lambda a, s: F.struct(F.greatest(a["at"], s["hi"].cast("long")).alias("at"), (a["sum"] + F.greatest(s["hi"].cast("long") - F.greatest(a["at"], s["lo"].cast("long")), F.lit(0).cast("long"))).alias("sum"))
    return F.aggregate(F.sort_array(spans), start, step, lambda a: a["sum"])


def separated(places: DataFrame, ink: DataFrame, axis: str, share: float = COVERAGE) -> DataFrame:
    """I16: places (doc_id, pos, lo, hi, ...) with `drawn`: ink (doc_id, axis, x, y, w, h) of the axis covers a share of lo..hi within BAND of pos."""
    across, along = ("x", "y") if axis == "v" else ("y", "x")
    size = {"x": "w", "y": "h"}
    marks = ink.where(F.col("axis") == axis).select(
        F.col("doc_id").alias("_doc"), F.col(across).alias("_a"), (F.col(across) + F.col(size[across])).alias("_b"), F.col(along).alias("_lo"), (F.col(along) + F.col(size[along])).alias("_hi")
    )
    near = (F.col("doc_id") == F.col("_doc")) & (F.col("_a") <= F.col("pos") + BAND) & (F.col("_b") > F.col("pos") - BAND) & (F.col("_lo") < F.col("hi")) & (F.col("_hi") > F.col("lo"))
    span = F.when(F.col("_lo").isNotNull(), F.struct(F.greatest("_lo", "lo").alias("lo"), F.least("_hi", "hi").alias("hi")))
    held = places.join(marks.hint("merge"), near, "left").groupBy(*places.columns).agg(F.collect_list(span).alias("_spans"))
    return held.withColumn("drawn", _covered(F.col("_spans")) >= share * F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).drop("_spans")


def cells_of(lines: DataFrame, ink: DataFrame, min_cell: int = MIN_CELL) -> DataFrame:
    """doc_id, row, col, row_span, col_span, x, y, w, h of the cells between lines; what no ink separates is one cell.

    Cells of a row are joined first, then equal ranges of columns of rows below each other: both are islands
    over the grid's places.
    """
    places = lines.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("axis") == "v", F.col("pos")))).alias("xs"), F.array_sort(F.collect_set(F.when(F.col("axis") == "h", F.col("pos")))).alias("ys")
    ).where((F.size("xs") >= 2) & (F.size("ys") >= 2))
    rows = places.select("doc_id", "xs", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("ys") - 2), lambda i: F.struct(F.get("ys", i).alias("y1"), F.get("ys", i + 1).alias("y2")))).alias("r", "b"))
    rows = rows.where(F.col("b.y2") - F.col("b.y1") >= min_cell).select("doc_id", "xs", "r", "b.y1", "b.y2")
    slots = rows.select("doc_id", "r", "y1", "y2", "xs", F.posexplode("xs").alias("c", "pos")).withColumn("x2", F.get("xs", F.col("c") + 1)).where("x2 is not null")
    walls = separated(slots.select("doc_id", "r", "c", "pos", F.col("y1").alias("lo"), F.col("y2").alias("hi"), "x2"), ink, "v")
    in_row = Window.partitionBy("doc_id", "r").orderBy("c")
    cut = walls.withColumn("cell", F.sum(F.when((F.col("c") == 0) | F.col("drawn"), 1).otherwise(0)).over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
    wide = cut.groupBy("doc_id", "r", "cell").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.first("lo").alias("y1"), F.first("hi").alias("y2"), F.min("pos").alias("x1"), F.max("x2").alias("x2"))
    wide = wide.where(F.col("x2") - F.col("x1") >= min_cell)
    floors = separated(wide.select("doc_id", "r", "c1", "c2", F.col("y1").alias("pos"), F.col("x1").alias("lo"), F.col("x2").alias("hi"), "y2"), ink, "h")
    down = Window.partitionBy("doc_id", "c1", "c2").orderBy("r")
    starts = F.when(F.coalesce(F.col("r") == F.lag("r").over(down) + 1, F.lit(False)) & ~F.col("drawn"), 0).otherwise(1)
    tall = floors.withColumn("_s", starts).withColumn("span", F.sum("_s").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    cells = tall.groupBy("doc_id", "c1", "c2", "span").agg(F.min("r").alias("row"), F.count(F.lit(1)).cast("int").alias("row_span"), F.first("lo").alias("x"), F.first("hi").alias("x2"), F.min("pos").alias("y"), F.max("y2").alias("y2"))
    return cells.select("doc_id", "row", F.col("c1").alias("col"), "row_span", (F.col("c2") - F.col("c1") + 1).alias("col_span"), "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"))


def grid_cells(blobs: DataFrame) -> DataFrame:
    """Cells of pages from their blobs (doc_id, axis, box_id, x, y, w, h): writing removed, rules found, drawn out, cut into cells."""

    def kernel(table: pa.Table, page: np.ndarray, docs: pa.ChunkedArray) -> pa.Table:
        axis = table["axis"]
        ids = table["box_id"].to_numpy()
        boxes = paged.numbers(table, "x", "y", "w", "h")
        found = cells_on_pages(page, pc.fill_null(pc.equal(axis, "h"), False).to_numpy(), pc.fill_null(pc.equal(axis, "v"), False).to_numpy(), ids, boxes)
        at = found.pop("page")
        return pa.table({"doc_id": docs.take(pa.array(at)), **{k: pa.array(v.astype(np.int32)) for k, v in found.items()}})

    doc = blobs.schema["doc_id"].dataType.simpleString()
    return paged.by_page(blobs, kernel, f"doc_id {doc}, " + ", ".join(f"{c} int" for c in CELL))


#: What is known of a cell besides its page.
CELL = ("row", "col", "row_span", "col_span", "x", "y", "w", "h")


def _merged(page: np.ndarray, along: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, gap: int) -> tuple[np.ndarray, ...]:
    """`_flattened` on arrays: page, along, pos, lo, hi and line_id, in order of the places of both axes."""
    order, group = paged.gap_groups(page * 2 + along, at, ids, gap)
    if not len(order):
        return page, along, at, lo, hi, ids
    first = np.flatnonzero(paged.starts_of(group))
    pick = order[first]
    count = np.add.reduceat(~np.isnan(at[order]), first, dtype=float)
    place = np.floor(np.add.reduceat(np.nan_to_num(at[order]), first) / np.where(count > 0, count, np.nan))
    own = (page * 2 + along)[pick]
    number = np.arange(len(pick)) - np.flatnonzero(paged.starts_of(own))[np.cumsum(paged.starts_of(own)) - 1]
    return page[pick], along[pick], place, np.fmin.reduceat(lo[order], first), np.fmax.reduceat(hi[order], first), number


def _drawn(page: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, ink_page: np.ndarray, ink: paged.Sides, share: float = COVERAGE) -> np.ndarray:
    """`separated` on arrays: whether ink (its two sides across, its two ends) covers a share of lo..hi within BAND of pos."""
    a, b, start, end = ink
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for i, j in paged.meeting(page, (pos - BAND, pos + BAND, lo, hi), ink_page, ink):
        near = (a[j] <= pos[i] + BAND) & (b[j] > pos[i] - BAND) & (start[j] < hi[i]) & (end[j] > lo[i])
        found.append((i[near], j[near]))
    i, j = (np.concatenate(part) for part in zip(*found, strict=True))
    s, e = np.maximum(start[j], lo[i]), np.minimum(end[j], hi[i])
    order = np.lexsort((e, s, i))
    i, s, e = i[order], s[order], e[order]
    covered = np.zeros(len(page))
    if len(i):
        # the furthest end before each span; places lie apart from each other by more than all spans
        apart = (e.max() - s.min() + 1) * i
        before = np.concatenate([[-np.inf], np.maximum.accumulate(e + apart)[:-1]]) - apart
        before[paged.starts_of(i)] = -np.inf
        covered = np.bincount(i, np.maximum(e - np.maximum(before, s), 0), len(page))
    return covered >= share * np.maximum(hi - lo, 1)


def cells_on_pages(page: np.ndarray, flat: np.ndarray, upright: np.ndarray, ids: np.ndarray, boxes: list[np.ndarray]) -> dict[str, np.ndarray]:
    """I18 on arrays: page and CELL of the cells of pages from their blobs (page, axis h, axis v, box_id, and x, y, w, h); the steps are those of the functions above."""
    keep = upright.copy()
    keep[flat] = not_writing(page[flat], ids[flat], [c[flat] for c in boxes], page[upright], [c[upright] for c in boxes])
    page, along, ids, (x, y, w, h) = page[keep], flat[keep], ids[keep], [c[keep] for c in boxes]
    # rules
    long = np.where(along, w, h) >= MIN_LENGTH
    pos = np.where(along, y + np.floor(h / 2), x + np.floor(w / 2))
    lines = (page, along, pos, np.where(along, x, y), np.where(along, x + w, y + h), ids)
    lpage, lalong, pos, lo, hi, _ = _merged(*_merged(*(c[long] for c in lines), FLATTEN_GAP), MERGE_GAP)
    # Rules that meet one of the other axis
    box = (np.where(lalong, lo, pos), np.where(lalong, hi, pos), np.where(lalong, pos, lo), np.where(lalong, pos, hi))
    crossing = np.zeros(len(pos), bool)
    across, down = np.flatnonzero(lalong), np.flatnonzero(~lalong)
    wide = lambda at: (box[0][at] - MEETING, box[1][at] + MEETING, box[2][at] - MEETING, box[3][at] + MEETING)
    for i, j in paged.meeting(lpage[across], wide(across), lpage[down], wide(down)):
        p, q = across[i], down[j]
        near = np.ones(len(p), bool)
        for lo_, hi_ in ((box[0], box[1]), (box[2], box[3])):
            near &= (lo_[p] - MEETING <= hi_[q]) & (lo_[q] - MEETING <= hi_[p])
        crossing[p[near]] = crossing[q[near]] = True
    lpage, lalong, pos, lo, hi = (c[crossing] for c in (lpage, lalong, pos, lo, hi))
    # Short ones go; places of rules are all that cells need of them, and a crossing rule's page has both axes
    n = int(lpage.max()) + 1 if len(lpage) else 0
    left, right, top, bottom = np.full(n, np.inf), np.full(n, -np.inf), np.full(n, np.inf), np.full(n, -np.inf)
    np.fmin.at(left, lpage, np.where(lalong, lo, pos))
    np.fmax.at(right, lpage, np.where(lalong, hi, pos))
    np.fmin.at(top, lpage, np.where(lalong, pos, lo))
    np.fmax.at(bottom, lpage, np.where(lalong, pos, hi))
    extent = np.where(lalong, (right - left)[lpage], (bottom - top)[lpage])
    kept = hi - lo >= EXTENT * np.maximum(extent, 1)
    lpage, lalong, pos = lpage[kept], lalong[kept], pos[kept]
    # Places between distinct rules
    sorted_ = []
    for own in (~lalong, lalong):
        p, at = lpage[own], pos[own]
        order = np.lexsort((at, p))
        p, at = p[order], at[order]
        once = paged.starts_of(p, at)
        sorted_.append((p[once], at[once]))
    (xp, xs), (yp, ys) = sorted_
    many, first = np.bincount(xp, minlength=n), np.searchsorted(xp, np.arange(n))
    same = yp[1:] == yp[:-1]
    row = np.arange(len(ys)) - np.searchsorted(yp, yp)
    rp, r, y1, y2 = yp[:-1][same], row[:-1][same], ys[:-1][same], ys[1:][same]
    high = (y2 - y1 >= MIN_CELL) & (many[rp] >= 2)
    rp, r, y1, y2 = rp[high], r[high], y1[high], y2[high]
    slots = many[rp] - 1
    of = np.repeat(np.arange(len(rp)), slots)
    c = np.arange(len(of)) - np.repeat(np.cumsum(slots) - slots, slots)
    at = first[rp[of]] + c
    ink = lambda own, axis: (page[own], (y[own], (y + h)[own], x[own], (x + w)[own]) if axis == "h" else (x[own], (x + w)[own], y[own], (y + h)[own]))
    wall = _drawn(rp[of], xs[at], y1[of], y2[of], *ink(~along, "v")) if len(of) else np.zeros(0, bool)
    start = np.flatnonzero((c == 0) | wall)
    last = np.append(start[1:], len(c)) - 1 if len(start) else start
    cp, cr, c1, c2, x1, x2, y1, y2 = rp[of][start], r[of][start], c[start], c[last], xs[at[start]], xs[at[last] + 1] if len(last) else xs[:0], y1[of][start], y2[of][start]
    broad = x2 - x1 >= MIN_CELL
    cp, cr, c1, c2, x1, x2, y1, y2 = (v[broad] for v in (cp, cr, c1, c2, x1, x2, y1, y2))
    floor = _drawn(cp, y1, x1, x2, *ink(along, "h")) if len(cp) else np.zeros(0, bool)
    order = np.lexsort((cr, c2, c1, cp))
    cp, cr, c1, c2, x1, x2, y1, y2, floor = (v[order] for v in (cp, cr, c1, c2, x1, x2, y1, y2, floor))
    begins = paged.starts_of(cp, c1, c2) | floor
    begins[1:] |= cr[1:] != cr[:-1] + 1
    start = np.flatnonzero(begins)
    last = np.append(start[1:], len(cp)) - 1 if len(start) else start
    return {"page": cp[start], "row": cr[start], "col": c1[start], "row_span": last - start + 1, "col_span": c2[start] - c1[start] + 1, "x": x1[start], "y": y1[start], "w": x2[start] - x1[start], "h": y2[last] - y1[start]}
