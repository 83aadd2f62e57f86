"""The tilt of pages by votes of their ruled lines (I02), as relations over runs of ink.

Every run votes, in short pieces with their length, for the lines through their middles: one for each whole degree, told apart by their
distance from the corner. The degree at which the votes are gathered in the fewest places is about the page's. The
places of enough votes there are segments; each segment's angle comes from the moments of its runs, to
fractions of a degree, and the page's is their median.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import apply_matrix, fold_angle, rotated_canvas

#: Votes and extent of a segment, and angles in degrees that a page isn't turned by: larger is a bad measurement, smaller not worth it.
LEAST_VOTES, LEAST_EXTENT, MOST_ANGLE, LEAST_ANGLE = 100, 150, 20.0, 0.1
#: Width of a place in pixels; places are tried with two offsets, so that few segments are cut by their edges.
PLACE = 8
#: Pixels of a run that vote together.
PIECE = 32


def _pieces(u: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs cut into pieces of PIECE pixels at most, so that a long one is gathered at its own degree alone; sums of moments stay the same."""
    count = -(-(hi - lo) // PIECE)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    low = np.repeat(lo, count) + k * PIECE
    high = np.minimum(low + PIECE, np.repeat(hi, count))
    return (low + high - 1) / 2, np.repeat(v, count), low, high, np.repeat(along, count)


def _gathered(u: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, along: np.ndarray) -> list[tuple]:
    """(axis, votes, extent, su, sv, suu, suv, svv) of the places of enough votes at a page's best degree; runs by their middles u, v."""
    n = (hi - lo).astype(float)
    best = None
    for degree in sorted(range(-45, 46), key=abs):
        slant = math.radians(degree)
        rho = v * math.cos(slant) - u * math.sin(slant)
        for offset in (0, PLACE // 2):
            place = np.floor((rho + offset) / PLACE).astype(np.int64)
            first = int(place.min())
            # places of both axes beside each other
            width = int(place.max()) - first + 1
            slot = place - first + along * width
            votes = np.bincount(slot, n, 2 * width)
            # most votes in few places; of equals the smaller turn, then the smaller degree and offset
            rank = (-float(votes @ votes), abs(degree), degree, offset)
            if best is None or rank < best[0]:
                best = (rank, slot, votes, width)
    _, slot, votes, width = best
    low, high = np.full(2 * width, np.iinfo(np.int64).max), np.full(2 * width, np.iinfo(np.int64).min)
    np.minimum.at(low, slot, lo)
    np.maximum.at(high, slot, hi)
    kept = np.flatnonzero(votes >= LEAST_VOTES)
    kept = kept[high[kept] - low[kept] >= LEAST_EXTENT]
    # a run is as wide as it is long
    sums = [np.bincount(slot, w, 2 * width)[kept] for w in (n * u, n * v, n * u * u + n * n * n / 12, n * u * v, n * v * v)]
    axes = np.where(kept < width, "h", "v")
    return list(zip(axes.tolist(), votes[kept].tolist(), (high[kept] - low[kept]).tolist(), *[x.tolist() for x in sums], strict=True))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of `_gathered` of pages (doc_id, runs), one row each."""
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), *[pa.float64()] * 5]
    names = ["doc_id", "axis", "votes", "extent", "su", "sv", "suu", "suv", "svv"]
    for batch in batches:
        runs = batch.column(1)
        flat, offsets = runs.flatten(), runs.offsets.to_numpy() - (runs.offsets[0].as_py() if len(runs) else 0)
        u, v, lo, hi, along = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "lo", "hi", "along"))
        rows = []
        for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
            rows += [(doc_id, *place) for place in _gathered(*_pieces(u[a:b], v[a:b], lo[a:b], hi[a:b], along[a:b]))]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def segments(runs: DataFrame) -> DataFrame:
    """doc_id, axis, angle, votes and extent of the ruled lines of pages.

    runs: doc_id, axis (h: along a row, v: along a column), line (the row or column), lo, hi (half-open). A page's runs come
    together in one row; the votes, 182 for each run, are counted there and never leave their task.
    """
    middle = (F.col("lo") + F.col("hi") - 1) / 2
    # columns are rows of the page turned by 90 degrees
    across = F.when(F.col("axis") == "h", F.col("line")).otherwise(-F.col("line"))
    run = F.struct(middle.cast("double").alias("u"), across.cast("double").alias("v"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.when(F.col("axis") == "h", 0).otherwise(1).cast("long").alias("along"))
    pages = runs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(run).alias("runs"))
    kept = pages.mapInArrow(_vote, "doc_id long, axis string, votes double, extent long, su double, sv double, suu double, suv double, svv double")
    moment = lambda both, a, b: F.col(both) - F.col(a) * F.col(b) / F.col("votes")
    angle = F.degrees(F.atan2(2 * moment("suv", "su", "sv"), moment("suu", "su", "su") - moment("svv", "sv", "sv"))) / 2
    return kept.select("doc_id", "axis", fold_angle(angle).alias("angle"), "votes", "extent")


def tilts(runs: DataFrame, pages: DataFrame, most: float = MOST_ANGLE, least: float = LEAST_ANGLE) -> DataFrame:
    """doc_id, angle (0 without a segment), n (segments) and skipped of each of pages (doc_id): why a page isn't turned, else null.

    no_lines: nothing to measure; too_large: past `most`, a bad measurement; level: within `least`.
    """
    measured = segments(runs).groupBy("doc_id").agg(F.median("angle").alias("angle"), F.count(F.lit(1)).alias("n"))
    joined = pages.select("doc_id").join(measured, "doc_id", "left").select("doc_id", F.coalesce("angle", F.lit(0.0)).alias("angle"), F.coalesce("n", F.lit(0)).alias("n"))
    size = F.abs("angle")
    return joined.withColumn("skipped", F.when(F.col("n") == 0, "no_lines").when(size > most, "too_large").when(size < least, "level"))


def mapped(matrix: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """the box around what a homography makes of a box: x, y, w, h in whole pixels."""
    points = F.array(*[apply_matrix(matrix, a, b) for a in (x, x + w) for b in (y, y + h)])
    edge = lambda pick, c: pick(F.transform(points, lambda p: p[c]))
    left, top = F.floor(edge(F.array_min, "x") + 1e-9).cast("int"), F.floor(edge(F.array_min, "y") + 1e-9).cast("int")
    right, bottom = F.ceil(edge(F.array_max, "x") - 1e-9).cast("int"), F.ceil(edge(F.array_max, "y") - 1e-9).cast("int")
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def levelled(boxes: DataFrame, found: DataFrame, pages: DataFrame) -> DataFrame:
    """boxes (doc_id, x, y, w, h, ...) of pages (doc_id, page_w, page_h) where they are once the page is turned by its tilt (F55); skipped pages stay."""
    canvas = found.where("skipped is null").join(pages, "doc_id").select("doc_id", rotated_canvas(F.col("page_w"), F.col("page_h"), F.col("angle")).alias("canvas"))
    whole = F.concat("canvas.matrix", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    moved = boxes.join(canvas, "doc_id", "left").withColumn("to", F.when(F.col("canvas").isNotNull(), mapped(whole, *(F.col(c) for c in "xywh"))))
    return moved.select(*[F.coalesce(F.col(f"to.{c}"), F.col(c)).alias(c) if c in set("xywh") else F.col(c) for c in boxes.columns])
