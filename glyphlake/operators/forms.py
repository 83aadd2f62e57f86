"""Roles of the cells of a printed form (A14, R20, W02, W07, W13, W14) and boxes cut at its columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paged
from .cluster import pair_clusters
from .layout import ZONE_TOLERANCE
from .spatial import column_kind

# Roles of the columns, the header row and the totals row, from left to right.
COLUMN_ROLES = ("notes", "line_total", "unit_price", "quantity", "product_name", "line_number")
HEADER_ROLES = ("city", "invoice_date", "merchant_name")
FOOTER_ROLES = ("label", "total_in_words", "label", "total_in_figures", "total_amount")
DATA_ROWS, SLACK, REACH = 10, 5, 0.4
EDGE_SHARE, BAND = 0.20, 20


def label_form(cells: DataFrame, tables: DataFrame, columns: tuple[str, ...] = COLUMN_ROLES, headers: tuple[str, ...] = HEADER_ROLES, footers: tuple[str, ...] = FOOTER_ROLES) -> DataFrame:
    """doc_id, cell_id, zone and role of the cells (doc_id, cell_id, x, y, w, h) of pages with a table (doc_id, top, bottom).

    The longest run of printed rows of about as many cells as there are columns is the item table: its first
    row holds the column headers, the next DATA_ROWS rows items, each cell that of the nearest column of the
    template (W14), if near enough. The row after the items, else after the run, else the first below the
    table holds the totals, by place if there are as many cells as roles, else by position (W13). Above, the
    cell nearest to the corner is the invoice number (A14); the others of the lowest row go by position.
    All of it is done for whole pages side by side (`paged`), after one sort of their cells.
    """
    numbers = [F.col(c).cast("double").alias(c) for c in "xywh"]
    bounds = tables.select("doc_id", F.col("top").cast("double").alias("y"), F.col("bottom").cast("double").alias("h"), F.lit(True).alias("_table"))
    both = cells.select("doc_id", "cell_id", *numbers, F.lit(False).alias("_table")).unionByName(bounds, allowMissingColumns=True)
    zones, roles = pa.array(ZONES), pa.array([*footers, "invoice_number", *headers, "column_header", *columns, "unknown"])

    def kernel(table: pa.Table, page: np.ndarray, docs: pa.ChunkedArray) -> pa.Table:
        is_table = table["_table"].to_numpy()
        x, y, w, h = paged.numbers(table, *"xywh")
        top, bottom, known = np.full(len(docs), np.nan), np.full(len(docs), np.nan), np.zeros(len(docs), bool)
        top[page[is_table]], bottom[page[is_table]], known[page[is_table]] = y[is_table], h[is_table], True
        at = np.flatnonzero(~is_table & known[page])
        ids = table["cell_id"].take(pa.array(at))
        order, zone, role = roles_on_pages(page[at], ids.to_numpy(), x[at] + w[at] / 2, y[at] + h[at] / 2, h[at], top, bottom, len(columns), len(headers), len(footers))
        return pa.table({"doc_id": docs.take(pa.array(page[at][order])), "cell_id": ids.take(pa.array(order)), "zone": zones.take(pa.array(zone)), "role": roles.take(pa.array(role))})

    kind = lambda c: cells.schema[c].dataType.simpleString()
    return paged.by_page(both, kernel, f"doc_id {kind('doc_id')}, cell_id {kind('cell_id')}, zone string, role string")


#: Zones in the order of their numbers.
ZONES = ("header", "table", "footer", "unknown")


def roles_on_pages(page: np.ndarray, ids: np.ndarray, cx: np.ndarray, cy: np.ndarray, h: np.ndarray, top: np.ndarray, bottom: np.ndarray, n: int, n_headers: int, n_footers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R20 on arrays: an order of the cells (page, cell_id, middle, height), and in that order their zones and roles; roles are numbers of
    totals, invoice number, header fields, column header, columns and unknown, one after the other."""
    pages = len(top)
    low, high = top[page], bottom[page]
    zone = np.select([np.isnan(low) | np.isnan(high), cy < low - ZONE_TOLERANCE, cy > high + ZONE_TOLERANCE], [3, 0, 2], 1)
    # Printed rows of a zone, and their cells from left to right
    group = page * len(ZONES) + zone
    order, line = paged.mean_groups(group, cy, ids, np.fmax(10.0, 0.6 * paged.medians(group, h))[group])
    row = np.cumsum(paged.starts_of(group[order], line)) - 1
    inner = np.lexsort((ids[order], cx[order], row))
    order, line = order[inner], line[inner]
    page, zone, ids, cx, cy = (c[order] for c in (page, zone, ids, cx, cy))
    first = np.flatnonzero(paged.starts_of(row))
    count = np.diff(np.append(first, len(row)))
    ordinal, many = paged.numbered(row), count[row]

    def spans(of: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least of value for each number of `of`, and how far it is to the greatest, 1 at least."""
        size = pages if of is page else len(first)
        least, most = np.full(size, np.inf), np.full(size, -np.inf)
        np.fmin.at(least, of[at], value[at])
        np.fmax.at(most, of[at], value[at])
        return least, np.fmax(most - least, 1.0)

    def bucket_of(share: np.ndarray, parts: int) -> np.ndarray:
        return np.minimum(parts - 1, np.floor(share * parts)).astype(int)

    # the longest run of full rows; of equals the first
    rpage, rzone, rline = page[first], zone[first], line[first]
    full = (rzone == 1) & (count >= n) & (count <= n + SLACK)
    fpage, fline = rpage[full], rline[full]
    begins = paged.starts_of(fpage)
    begins[1:] |= fline[1:] != fline[:-1] + 1
    run = np.flatnonzero(begins)
    length = np.diff(np.append(run, len(fpage)))
    best = np.lexsort((fline[run], -length, fpage[run]))
    best = best[paged.starts_of(fpage[run][best])]
    start, stop, lines = np.full(pages, np.nan), np.full(pages, np.nan), np.full(pages, np.nan)
    start[fpage[run][best]] = fline[run][best]
    stop[fpage[run][best]] = fline[run][best] + length[best]
    np.fmax.at(lines, rpage[rzone == 1], rline[rzone == 1] + 1.0)
    after = start + 1 + np.minimum(stop - start - 1, DATA_ROWS)
    totals = np.where(after < lines, after, np.where(stop < lines, stop, np.nan))

    # the template: rows of exactly n cells vote, if there are any
    inside = (zone == 1) & (line >= start[page]) & (line < stop[page])
    clean = np.zeros(pages, bool)
    clean[page[inside & (many == n)]] = True
    votes = inside & (~clean[page] | (many == n)) & (ordinal < n)
    center = paged.medians(page[votes] * n + ordinal[votes], cx[votes], pages * n).reshape(pages, n)
    role = np.full(len(page), n_footers + 1 + n_headers + 1 + n)
    items = np.flatnonzero(inside & (line < after[page]))
    own = center[page[items]]
    far = np.abs(cx[items][:, None] - own)
    near = far.argmin(axis=1) if n else np.zeros(0, int)
    close = far[np.arange(len(items)), near] <= REACH * (own.max(axis=1) - own.min(axis=1)) / (n - 1)
    head = n_footers + 1 + n_headers
    role[items[close]] = np.where(line[items] == start[page[items]], head, head + 1 + near)[close]

    # the totals row
    closing = np.flatnonzero(((zone == 1) & (line == totals[page])) | ((zone == 2) & np.isnan(totals[page]) & (line == 0)))
    least, wide = spans(row, closing, cx)
    place = bucket_of((cx[closing] - least[row[closing]]) / wide[row[closing]], n_footers)
    role[closing] = np.where(many[closing] == n_footers, ordinal[closing], place)

    # above the table: the cell nearest to the corner, then the others of the lowest row
    above = np.flatnonzero(zone == 0)
    score = np.zeros(len(above))
    for value in (cx, cy):
        least, wide = spans(page, above, value)
        score = score + (value[above] - least[page[above]]) / wide[page[above]]
    ranked = above[np.lexsort((ids[above], score, page[above]))]
    number = ranked[paged.starts_of(page[ranked])]
    role[number] = n_footers
    lowest = np.full(pages, -1)
    np.maximum.at(lowest, page[above], line[above])
    field = (zone == 0) & (line == lowest[page])
    field[number] = False
    field = np.flatnonzero(field)
    least, wide = spans(page, field, cx)
    role[field] = n_footers + 1 + bucket_of((cx[field] - least[page[field]]) / wide[page[field]], n_headers)
    return order, zone, role


def split_at_columns(boxes: DataFrame, kinds: list[tuple[float, float, str]], min_width: int = 45, inset: int = 10) -> DataFrame:
    """Boxes (doc_id, box_id, x, y, w, h, page_w, page_h, ...) cut at the boundaries of declared columns, with `part` from 0.

    Boxes in the upper and lower EDGE_SHARE of the page aren't cut. A cut needs min_width on both sides; pieces
    are drawn in from a cut by inset, and those that are too narrow go; without any left the box stays whole.
    """
    edges = sorted({edge for start, end, _ in kinds for edge in (start, end) if 0 < edge < 1})
    right = F.col("x") + F.col("w")
    middle = F.col("y") + F.col("h") / 2
    inner = (middle >= EDGE_SHARE * F.col("page_h")) & (middle <= (1 - EDGE_SHARE) * F.col("page_h"))
    # columns for each edge instead of arrays and functions of them, which aren't compiled; edges are in order, so the last cut is the greatest
    names = [f"_cut{i}" for i in range(len(edges))]
    at = [F.rint(F.lit(e) * F.col("page_w")).cast("int") for e in edges]
    fits = lambda b: inner & (b > F.col("x") + min_width) & (b < right - min_width)
    stops = boxes.withColumns({n: F.when(fits(b) if i == 0 else fits(b) & (b != at[i - 1]), b) for i, (n, b) in enumerate(zip(names, at, strict=True))}) if edges else boxes

    def last(before: list[str]) -> Column:
        return F.lit(None).cast("int") if not before else F.col(before[0]) if len(before) == 1 else F.greatest(*before)

    any_cut = F.coalesce(*names).isNotNull() if len(names) > 1 else F.col(names[0]).isNotNull() if names else F.lit(False)
    pieces = {}
    for i in range(len(edges) + 1):
        cut, end = last(names[:i]), F.col(names[i]) if i < len(edges) else right
        start = F.coalesce(cut, F.col("x"))
        left, to = F.when(cut.isNotNull(), cut + inset).otherwise(F.col("x")), end - inset if i < len(edges) else end
        wide = any_cut & (end - start >= min_width) & (to - left >= min_width)
        pieces[f"_piece{i}"] = F.when(wide, F.struct(left.cast("int").alias("x"), (to - left).cast("int").alias("w")))
    count = sum((F.when(F.col(p).isNotNull(), 1).otherwise(0) for p in list(pieces)[1:]), F.when(F.col("_piece0").isNotNull(), 1).otherwise(0))
    whole = F.when(count == 0, F.struct(F.col("x").cast("int").alias("x"), F.col("w").cast("int").alias("w")))
    placed, before = [], F.lit(0)
    for p in pieces:
        placed.append(F.when(F.col(p).isNotNull(), F.struct(before.cast("int").alias("part"), F.col(f"{p}.x").alias("x"), F.col(f"{p}.w").alias("w"))))
        before = before + F.when(F.col(p).isNotNull(), 1).otherwise(0)
    placed.append(F.when(whole.isNotNull(), F.struct(F.lit(0).alias("part"), whole["x"].alias("x"), whole["w"].alias("w"))))
    out = stops.withColumns(pieces).select(*[c for c in boxes.columns if c not in ("x", "w")], F.explode(F.array(*placed)).alias("_p")).where("_p is not null")
    return out.select(*[c for c in boxes.columns if c not in ("x", "w")], F.col("_p.part").alias("part"), F.col("_p.x").alias("x"), F.col("_p.w").alias("w"))


def missing_cells(boxes: DataFrame, kinds: list[tuple[float, float, str]], min_width: int = 45, inset: int = 10, share: float = 0.35) -> DataFrame:
    """doc_id, x, y, w, h and kind of boxes made up for columns that printed rows of two boxes or more left empty.

    boxes: doc_id, box_id, x, y, w, h, page_w. A made-up box is as high as its row and has no confidence.
    """
    lo, hi = min(k[0] for k in kinds), max(k[1] for k in kinds)
    middle = F.col("x") + F.col("w") / 2
    inside = boxes.where((middle >= lo * F.col("page_w")) & (middle <= hi * F.col("page_w"))).withColumn("cy", F.col("y") + F.col("h") / 2)
    lines = pair_clusters(inside, ["doc_id"], "cy", "h", "box_id", share)
    rows = lines.groupBy("doc_id", "cluster").agg(F.min("y").alias("y"), F.max(F.col("y") + F.col("h")).alias("y2"), F.first("page_w").alias("page_w"), F.collect_set(middle).alias("middles"), F.count(F.lit(1)).alias("n"))
    column = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("kind")) for a, b, k in kinds])).alias("c")
    tried = rows.where("n >= 2").select("*", column).withColumns({"x1": (F.col("c.a") * F.col("page_w")).cast("int"), "x2": (F.col("c.b") * F.col("page_w")).cast("int")})
    empty = tried.where(~F.exists("middles", lambda m: (m > F.col("x1")) & (m < F.col("x2"))) & (F.col("x2") - F.col("x1") - 2 * inset >= min_width))
    return empty.select("doc_id", (F.col("x1") + inset).alias("x"), "y", (F.col("x2") - F.col("x1") - 2 * inset).alias("w"), (F.col("y2") - F.col("y")).alias("h"), F.col("c.kind").alias("kind"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Boxes (doc_id, x, y, ...) with `place` from 0: bands of BAND pixels from top to bottom, in a band from right to left, then by input order (ord)."""
    order = Window.partitionBy("doc_id").orderBy(F.rint(F.col("y") / BAND), F.desc("x"), "ord")
    return boxes.withColumn("place", (F.row_number().over(order) - 1).cast("int"))


def refined(boxes: DataFrame, kinds: list[tuple[float, float, str]], default: str = "any", min_width: int = 45, inset: int = 10) -> DataFrame:
    """doc_id, place, x, y, w, h, confidence and kind of detected boxes, cut, filled up, in reading order.

    A box that has no kind gets that of the declared column its middle lies in. boxes: doc_id, box_id, x, y, w, h,
    confidence, page_w, page_h.
    """
    cut = split_at_columns(boxes, kinds, min_width, inset)
    pages = cut.groupBy("doc_id").agg(F.first("page_w").alias("page_w"))
    made = missing_cells(cut.withColumn("box_id", F.struct("box_id", "part")), kinds, min_width, inset).join(pages, "doc_id")
    known = cut.select("doc_id", "x", "y", "w", "h", "confidence", F.lit(None).cast("string").alias("kind"), "page_w", F.struct(F.lit(0).alias("made"), F.col("box_id").cast("long").alias("id"), F.col("part").alias("part")).alias("ord"))
    new = made.select("doc_id", "x", "y", "w", "h", F.lit(None).cast("double").alias("confidence"), "kind", "page_w", F.struct(F.lit(1).alias("made"), F.col("y").cast("long").alias("id"), F.col("x").cast("int").alias("part")).alias("ord"))
    whole = reading_order(known.unionByName(new))
    fraction = (F.col("x") + F.col("w") / 2) / F.col("page_w")
    return whole.select("doc_id", "place", "x", "y", "w", "h", "confidence", F.coalesce("kind", column_kind(fraction, kinds, default)).alias("kind"))
