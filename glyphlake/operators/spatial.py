"""Joins of boxes on pages (J01-J03, J10-J16, A03, A04, A15, A17, I14). Every join has doc_id among its keys, so a page meets itself only.

A page's boxes are dealt into tiles, as many as its boxes call for (`meeting`), and meet within a tile: a page of few boxes
is one tile, and on a crowded one a box meets its surroundings instead of the page. Tiles are keys beside
doc_id, so tables that are dealt out by doc_id stay where they are. Joins ask for a merge: by the size of files Spark takes
boxes made by an explode for few, and would send them whole through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import blank
from ..functions.geometry import Box, closeness, contains, ioa, iou, overlaps
from .cells import merged_texts

# Weights and threshold of the best-region score.
IOA_WEIGHT, IOU_WEIGHT, DISTANCE_WEIGHT, LEAST_SCORE = 0.3, 0.7, 0.0, 0.25
_XYWH = ("x", "y", "w", "h")


#: Boxes in a tile, on average.
PER_TILE = 32


def _tiles(boxes: DataFrame, keys: tuple[str, ...], reach: float) -> DataFrame:
    """keys, tile_w and tile_h of each page: about PER_TILE boxes a tile, and no tile smaller than two average boxes."""
    per_side = F.sqrt(F.greatest(F.count(F.lit(1)) / PER_TILE, F.lit(1.0)))
    side = lambda at, size: F.greatest((F.max(F.col(at) + F.col(size)) - F.min(at) + 2 * reach + 1) / per_side, 2 * F.avg(size) + 2 * reach + 1)
    return boxes.groupBy(*keys).agg(side("x", "w").alias("tile_w"), side("y", "h").alias("tile_h"))


def _dealt(boxes: DataFrame, tiles: DataFrame, keys: tuple[str, ...], prefix: str, reach: float) -> DataFrame:
    """A row of each box for each tile that it meets when grown by reach: keys, tile_x, tile_y, tile_w, tile_h and the prefixed columns."""
    reached = lambda at, size, tile: F.sequence(F.floor((F.col(at) - reach) / F.col(tile)).cast("int"), F.floor((F.col(at) + F.col(size) + reach) / F.col(tile)).cast("int"))
    placed = boxes.join(tiles.hint("merge"), list(keys)).withColumn("tile_x", F.explode(reached("x", "w", "tile_w"))).withColumn("tile_y", F.explode(reached("y", "h", "tile_h")))
    own = [c for c in boxes.columns if c not in keys]
    return placed.select(*keys, "tile_x", "tile_y", "tile_w", "tile_h", *[F.col(c).alias(prefix + c) for c in own])


def meeting(left: DataFrame, right: DataFrame, reach: float = 0, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and the columns (a_..., b_...) of pairs of boxes of a page that meet when both are grown by reach, and touch at least.

    A pair that meets in several tiles is reported in that of its corner: the larger left and the larger top.
    """
    tiles = _tiles(right, keys, reach)
    a = _dealt(left, tiles, keys, "a_", reach)
    b = _dealt(right, tiles, keys, "b_", reach).drop("tile_w", "tile_h")
    pairs = a.join(b.hint("merge"), [*keys, "tile_x", "tile_y"])
    corner = lambda at, tile: F.floor((F.greatest(f"a_{at}", f"b_{at}") - reach) / F.col(tile))
    return pairs.where((F.col("tile_x") == corner("x", "tile_w")) & (F.col("tile_y") == corner("y", "tile_h"))).drop("tile_x", "tile_y", "tile_w", "tile_h")


def identity_join(fragments: DataFrame, regions: DataFrame) -> DataFrame:
    """Fragments with a source_id and the region of that id (null: unknown, never guessed)."""
    named = fragments.where(F.col("source_id").isNotNull())
    ids = regions.select("doc_id", F.col("region_id").alias("source_id"), "region_id")
    return named.join(ids, ["doc_id", "source_id"], "left").select("doc_id", "frag_id", "region_id")


def best_region(fragments: DataFrame, regions: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The best region of each fragment without a source_id: doc_id, frag_id, region_id, score.

    Only overlapping regions can score while the distance has no weight, so others aren't paired. Ties go
    to the smaller, then the earlier region.
    """
    probes = fragments.where(F.col("source_id").isNull()).select("doc_id", "frag_id", *_XYWH)
    targets = regions.select("doc_id", "region_id", "ord", *_XYWH)
    f, r = Box.of("a_"), Box.of("b_")
    score = IOA_WEIGHT * ioa(f, r) + IOU_WEIGHT * iou(f, r) + DISTANCE_WEIGHT * closeness(f, r)
    pairs = meeting(probes, targets).where(overlaps(f, r)).select("doc_id", F.col("a_frag_id").alias("frag_id"), F.col("b_region_id").alias("region_id"), F.col("b_ord").alias("ord"), r.area.alias("area"), score.alias("score"))
    best = Window.partitionBy("doc_id", "frag_id").orderBy(F.desc("score"), "area", "ord")
    return pairs.where(F.col("score") >= least).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("doc_id", "frag_id", "region_id", "score")


def assemble(fragments: DataFrame, regions: DataFrame) -> DataFrame:
    """Every region with its fragments, then unassigned fragments as free:0, free:1, ...; blank fragments don't count.

    doc_id, element_id, kind (region, free), ord, n_fragments and text (the merged text of A07).
    """
    read = fragments.where(~blank(F.col("text")))
    ids = regions.select("doc_id", F.col("region_id").alias("source_id"), F.col("region_id").alias("_named"))
    best = best_region(read, regions).select("doc_id", "frag_id", F.col("region_id").alias("_best"))
    # a fragment with a source_id has no best region, so one of both at most is there
    whole = read.join(ids.hint("merge"), ["doc_id", "source_id"], "left").join(best.hint("merge"), ["doc_id", "frag_id"], "left").withColumn("region_id", F.coalesce("_named", "_best")).drop("_named", "_best")
    held = merged_texts(whole.where(F.col("region_id").isNotNull()), "doc_id", "region_id")
    filled = regions.select("doc_id", "region_id", "ord").join(held.hint("merge"), ["doc_id", "region_id"], "left")
    kept = filled.select("doc_id", F.col("region_id").alias("element_id"), F.lit("region").alias("kind"), "ord", F.coalesce("n", F.lit(0)).cast("long").alias("n_fragments"), F.coalesce("text", F.lit("")).alias("text"))
    count = regions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("regions"))
    free = whole.where(F.col("region_id").isNull()).join(count.hint("merge"), "doc_id", "left")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("frag_id")) - 1
    loose = free.select("doc_id", F.concat(F.lit("free:"), index.cast("string")).alias("element_id"), F.lit("free").alias("kind"), (F.coalesce("regions", F.lit(0)) + index).cast("int").alias("ord"), F.lit(1).cast("long").alias("n_fragments"), F.trim("text").alias("text"))
    return kept.unionByName(loose)


def innermost(boxes: DataFrame) -> DataFrame:
    """Boxes that contain no other box of their page; equal boxes drop each other."""
    own = boxes.select("doc_id", "box_id", *_XYWH)
    outer = meeting(own, own).where((F.col("a_box_id") != F.col("b_box_id")) & contains(Box.of("a_"), Box.of("b_")))
    return boxes.join(outer.select("doc_id", F.col("a_box_id").alias("box_id")).hint("merge"), ["doc_id", "box_id"], "left_anti").select(*boxes.columns)


def crossing_lines(lines: DataFrame, tolerance: int = 3) -> DataFrame:
    """Horizontal lines (doc_id, line_id, axis h or v, x, y, w, h) that meet a vertical one and the reverse, both of the unfiltered input."""
    def meets(a: Column, b: Column) -> Column:
        near = [(p[at] - tolerance <= q[at] + q[size]) for at, size in (("_x", "_w"), ("_y", "_h")) for p, q in ((a, b), (b, a))]
        return (a["_box"]["axis"] != b["_box"]["axis"]) & near[0] & near[1] & near[2] & near[3]

    return _marked(lines, None, ("doc_id",), meets, "_crossing", reach=tolerance / 2).where("_crossing").select(*lines.columns)


def overlap_edges(boxes: DataFrame, margin: int = 1) -> DataFrame:
    """Pairs of boxes of a page that overlap when both are grown by margin, the smaller id first."""
    own = boxes.select("doc_id", "box_id", *_XYWH)
    met = meeting(own, own, margin).where((F.col("a_box_id") < F.col("b_box_id")) & overlaps(Box.of("a_"), Box.of("b_"), margin))
    return met.select("doc_id", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"))


def _label_pages(margin: int):
    """Components of the boxes of pages (doc_id, boxes): pairs by a sweep along x over whole arrays, then least neighbours until nothing changes."""

    def label(page: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        order = np.lexsort((x, page))
        page, x, y, w, h = page[order], x[order], y[order], w[order], h[order]
        n, left, right = len(page), [], []
        alive, step = np.arange(n), 1
        both = 2 * margin  # both boxes grow
        stop = x + w + both  # boxes that start there or later don't overlap
        while len(alive):
            other = alive + step
            near = other < n
            alive, other = alive[near], other[near]
            ahead = (page[other] == page[alive]) & (x[other] < stop[alive])
            alive, other = alive[ahead], other[ahead]
            meets = (y[other] < y[alive] + h[alive] + both) & (y[alive] < y[other] + h[other] + both) & (x[alive] < x[other] + w[other] + both)
            left.append(alive[meets])
            right.append(other[meets])
            step += 1
        a, b = np.concatenate([np.zeros(0, int), *left]), np.concatenate([np.zeros(0, int), *right])
        root = np.arange(n)
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if np.array_equal(least, root):
                break
            root = least
        out = np.zeros(n, np.int64)
        out[order] = order[root]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("box_id", pa.int64()), ("component", pa.int64())])
        for batch in batches:
            boxes = batch.column(1)
            flat, offsets = boxes.flatten(), boxes.offsets.to_numpy() - boxes.offsets[0].as_py() if len(boxes) else np.zeros(1, int)
            page = np.repeat(np.arange(len(boxes)), np.diff(offsets))
            ids = flat.field("box_id").to_numpy()
            root = label(page, *(flat.field(c).to_numpy() for c in _XYWH))
            # a component is named by its least box
            names = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(names, root, ids)
            labels = pa.StructArray.from_arrays([pa.array(ids), pa.array(names[root])], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), labels)], ["doc_id", "labels"])

    return run


def page_components(boxes: DataFrame, margin: int = 1) -> DataFrame:
    """doc_id, box_id and component, the least box_id that overlaps lead to. A row holds one page's boxes."""
    pages = boxes.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct(F.col("box_id").cast("long").alias("box_id"), *_XYWH)).alias("boxes"))
    labelled = pages.mapInArrow(_label_pages(margin), "doc_id long, labels array<struct<box_id:long,component:long>>")
    return labelled.select("doc_id", F.inline("labels"))


def _marked(boxes: DataFrame, others: DataFrame | None, keys: tuple[str, ...], meets: Callable[[Column, Column], Column], name: str, flat: bool = False, reach: float = 0) -> DataFrame:
    """boxes with a flag `name`: whether one of others (without them: another box) with the same keys meets it, both grown by reach.

    Boxes and others are dealt into tiles as in `meeting` (flat: along x alone) and compared within a tile's row. There is no join:
    tables that are dealt out by doc_id stay where they are. A box that lies in several tiles is put together again by its columns.
    """
    own = F.struct(*[F.col(c) for c in boxes.columns]).alias("_box")
    places = ("x",) if flat else ("x", "y")
    place = [F.col(c).alias(f"_{c}") for at in places for c in (at, "w" if at == "x" else "h")]
    rows = boxes.select(*keys, own, *place, F.lit(others is None).alias("_other"))
    if others is not None:
        nothing = F.lit(None).cast(rows.schema["_box"].dataType).alias("_box")
        rows = rows.unionByName(others.select(*keys, nothing, *[F.col(c.replace("_", "")).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c in ("_x", "_y", "_w", "_h")], F.lit(True).alias("_other")))
    page = Window.partitionBy(*keys)
    of = lambda c: F.when(F.col("_other"), c)
    count = F.count(of(F.lit(1))).over(page)
    per_side = F.greatest(count / PER_TILE, F.lit(1.0)) if flat else F.sqrt(F.greatest(count / PER_TILE, F.lit(1.0)))
    for at, size in (("_x", "_w"), ("_y", "_h"))[: len(places)]:
        least, most, mean = F.min(of(F.col(at))).over(page), F.max(of(F.col(at) + F.col(size))).over(page), F.avg(of(F.col(size))).over(page)
        rows = rows.withColumn(f"_t{at}", F.greatest((most - least + 2 * reach + 1) / per_side, 2 * mean + 2 * reach + 1))
    # without any other box a page has no tiles, and one row does
    for at, size in (("_x", "_w"), ("_y", "_h"))[: len(places)]:
        tile = lambda v, at=at: F.coalesce(F.floor(v / F.col(f"_t{at}")).cast("int"), F.lit(0))
        rows = rows.withColumn(f"_t{at}", F.explode(F.sequence(tile(F.col(at) - reach), tile(F.col(at) + F.col(size) + reach))))
    held = F.struct("_box", *[f"_{c}" for at in places for c in (at, "w" if at == "x" else "h")])
    tiles = rows.groupBy(*keys, *[f"_t_{at}" for at in places]).agg(F.collect_list(F.when(F.col("_box").isNotNull(), held)).alias("_own"), F.collect_list(of(held)).alias("_others"))
    met = F.transform("_own", lambda a: F.struct(a["_box"].alias("_box"), F.exists("_others", lambda b: F.coalesce(meets(a, b), F.lit(False))).alias("_met")))
    told = tiles.select(*keys, F.inline(met)).select(*keys, *[F.col(f"_box.{c}").alias(c) for c in boxes.columns if c not in keys], "_met")
    return told.groupBy(*boxes.columns).agg(F.max("_met").alias(name))


def with_stacked(blobs: DataFrame, share: float = 0.5) -> DataFrame:
    """Blobs (doc_id, cluster, box_id, x, w, ...) with `stacked`: whether their width overlaps another one of their cluster by a share of the shorter or more."""

    def meets(a: Column, b: Column) -> Column:
        both = F.least(a["_x"] + a["_w"], b["_x"] + b["_w"]) - F.greatest(a["_x"], b["_x"])
        return (a["_box"]["box_id"] != b["_box"]["box_id"]) & (both >= share * F.least(a["_w"], b["_w"]))

    return _marked(blobs, None, ("doc_id", "cluster"), meets, "stacked", flat=True)


def with_crossed(blobs: DataFrame, rules: DataFrame) -> DataFrame:
    """Blobs (doc_id, box_id, x, y, w, h, ...) with `crossed`: whether a vertical rule (doc_id, x, y, w, h) of their page crosses them."""
    box = lambda v: Box(v["_x"], v["_y"], v["_w"], v["_h"])
    return _marked(blobs, rules, ("doc_id",), lambda a, b: overlaps(box(a), box(b)), "crossed")


def stacked_overlap(blobs: DataFrame, share: float = 0.5) -> DataFrame:
    """The blobs of `with_stacked` that are stacked."""
    return with_stacked(blobs, share).where("stacked").select(*blobs.columns)


def crossing_rules(blobs: DataFrame, rules: DataFrame) -> DataFrame:
    """The blobs of `with_crossed` that a rule crosses."""
    return with_crossed(blobs, rules).where("crossed").select(*blobs.columns)


def largest_component(components: DataFrame) -> DataFrame:
    """The component of most boxes of each page; of equals that of the least box."""
    sizes = components.groupBy("doc_id", "component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "component")).alias("b"))
    return best.select("doc_id", F.col("b.component").alias("component"), (-F.col("b.m")).alias("n"))


def hull(boxes: DataFrame, *keys: str) -> DataFrame:
    """The least box around all boxes of a key."""
    x, y = F.min("x"), F.min("y")
    return boxes.groupBy(*keys).agg(x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h"))


def padded_envelope(boxes: DataFrame, *keys: str, share: float = 0.02) -> DataFrame:
    """The hull grown by a share of its longer side, cut to whole pixels."""
    pad = (F.greatest("w", "h") * share).cast("int")
    return hull(boxes, *keys).select(*keys, (F.col("x") - pad).alias("x"), (F.col("y") - pad).alias("y"), (F.col("w") + 2 * pad).alias("w"), (F.col("h") + 2 * pad).alias("h"))


def quantised_distinct(boxes: DataFrame, tolerance: int = 5) -> DataFrame:
    """The first box (least box_id) of each page among those equal after rounding to tolerance, halves to even."""
    keys = [F.rint(F.col(c) / F.lit(float(tolerance))) for c in _XYWH]
    first = Window.partitionBy("doc_id", *keys).orderBy("box_id")
    return boxes.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def nearest_slot(items: DataFrame, slots: list[tuple[int, float]], reach: Column) -> DataFrame:
    """The slot nearest to each item (doc_id, item_id, center), null beyond reach; ties to the smaller slot.

    slots are the (slot, center) of a form, a few literals, so nothing is joined.
    """
    far = F.array_min(F.array(*[F.struct(F.abs(F.col("center") - F.lit(center)).alias("far"), F.lit(slot).alias("slot")) for slot, center in slots]))
    return items.withColumn("_b", far).select("doc_id", "item_id", F.when(F.col("_b.far") <= reach, F.col("_b.slot")).alias("slot"))


def column_kind(fraction: Column, columns: list[tuple[float, float, str]], default: str) -> Column:
    """The kind of the first declared half-open range that holds a fraction."""
    out = F.lit(default)
    for start, end, kind in reversed(columns):
        out = F.when((fraction >= start) & (fraction < end), kind).otherwise(out)
    return out


def missing_columns(cells: DataFrame, columns: int, least: int = 2) -> DataFrame:
    """(doc_id, row, col) for each column without a cell in rows that have `least` cells or more.

    One aggregate with a flag for each column: cells that met themselves in a join could be broadcast whole. A null in
    the key meets no cell, as in SQL.
    """
    known = F.col("doc_id").isNotNull() & F.col("row").isNotNull()
    held = [F.coalesce(F.bool_or(known & (F.col("col") == k)), F.lit(False)).alias(f"_{k}") for k in range(columns)]
    rows = cells.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("_n"), *held).where(F.col("_n") >= least)
    open_ = F.filter(F.array(*[F.when(~F.col(f"_{k}"), F.lit(k)) for k in range(columns)]), lambda k: k.isNotNull())
    return rows.select("doc_id", "row", F.explode(open_).alias("col"))
