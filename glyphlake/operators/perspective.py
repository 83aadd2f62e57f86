"""The page in a photo and its perspective (I01), as relations: least rectangle around an outline, and the matrix that makes it the page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let
from ..functions.geometry import matrix_inverse, matrix_product, ordered_corners
from .deskew import mapped

#: Share of the photo that a page covers at least: what is smaller is a word or a stamp.
LEAST_AREA = 0.2


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points, n x 2, in order; a chain below and one above, from left to right and back."""
    points = np.unique(np.stack([x, y], 1), axis=0)
    chains = []
    for row in (points, points[::-1]):
        chain: list[np.ndarray] = []
        for p in row:
            while len(chain) > 1 and np.cross(np.append(chain[-1] - chain[-2], 0), np.append(p - chain[-1], 0))[2] <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains if chains else points, np.float64).reshape(-1, 2)


def least_rectangle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of least area around points, 4 x 2: one of its sides lies along a side of their hull."""
    corners = hull(x, y)
    sides = np.roll(corners, -1, axis=0) - corners
    long = np.hypot(*sides.T)
    along = sides[long > 0] / long[long > 0][:, None] if (long > 0).any() else np.array([[1.0, 0.0]])
    across = np.stack([-along[:, 1], along[:, 0]], 1)
    u, v = corners @ along.T, corners @ across.T
    area = np.ptp(u, axis=0) * np.ptp(v, axis=0)
    k = int(np.argmin(area))
    ends = [(a, b) for a, b in ((u[:, k].min(), v[:, k].min()), (u[:, k].max(), v[:, k].min()), (u[:, k].max(), v[:, k].max()), (u[:, k].min(), v[:, k].max()))]
    return np.array([a * along[k] + b * across[k] for a, b in ends])


def _rectangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    for batch in batches:
        found = []
        for points in batch.column(1):
            flat = points.values
            corners = least_rectangle(flat.field("x").to_numpy(), flat.field("y").to_numpy())
            found.append([{"x": float(a), "y": float(b)} for a, b in corners])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "corners"])


def quad_matrix(corners: Column, w: Column, h: Column) -> Column:
    """The homography (nine numbers by rows) that takes four ordered corners to those of a page of w x h pixels; null for corners on a line."""

    def square(c: Column) -> Column:
        """The matrix from the unit square to the corners; its last row is null for corners on a line."""
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = [(F.get(c, F.lit(i))["x"], F.get(c, F.lit(i))["y"]) for i in range(4)]
        ax, bx, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
        ay, by, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
        whole = ax * by - bx * ay
        lean = F.array(F.try_divide(sx * by - bx * sy, whole), F.try_divide(ax * sy - sx * ay, whole))
        return let(lean, lambda e: F.array(x1 - x0 + F.get(e, F.lit(0)) * x1, x3 - x0 + F.get(e, F.lit(1)) * x3, x0, y1 - y0 + F.get(e, F.lit(0)) * y1, y3 - y0 + F.get(e, F.lit(1)) * y3, y0, F.get(e, F.lit(0)), F.get(e, F.lit(1)), F.lit(1.0)))

    zero = F.lit(0.0)
    scale = F.array((w - 1).cast("double"), zero, zero, zero, (h - 1).cast("double"), zero, zero, zero, F.lit(1.0))
    # bound step by step, or Catalyst would copy each step wherever the next one uses it
    back = let(let(corners, square), lambda m: F.when(F.get(m, F.lit(6)).isNotNull(), matrix_inverse(m)))
    return let(back, lambda m: F.when(m.isNotNull(), matrix_product(scale, m)))


def page_quads(outline: DataFrame, pages: DataFrame, least: float = LEAST_AREA) -> DataFrame:
    """doc_id, corners (from the top left, clockwise), w, h, matrix and skipped of each of pages (doc_id, page_w, page_h).

    outline: doc_id, x, y of points of the largest contour. skipped: no_outline, degenerate (a side under a
    pixel) or too_small (under a share of the photo); such pages have no matrix and stay as they are.
    """
    met = outline.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("points"))
    found = met.mapInArrow(_rectangles, "doc_id long, corners array<struct<x:double,y:double>>").withColumn("corners", ordered_corners(F.col("corners")))
    side = lambda i, j: F.hypot(F.get("corners", F.lit(i))["x"] - F.get("corners", F.lit(j))["x"], F.get("corners", F.lit(i))["y"] - F.get("corners", F.lit(j))["y"])
    longer = lambda a, b: F.floor(F.greatest(a, b)).cast("int")
    sized = pages.select("doc_id", "page_w", "page_h").join(found, "doc_id", "left").withColumns({"w": longer(side(2, 3), side(1, 0)), "h": longer(side(1, 2), side(0, 3))})
    share = F.col("w").cast("double") * F.col("h") / (F.col("page_w") * F.col("page_h"))
    skipped = F.when(F.col("corners").isNull(), "no_outline").when((F.col("w") <= 0) | (F.col("h") <= 0), "degenerate").when(share < least, "too_small")
    judged = sized.withColumn("skipped", skipped)
    return judged.select("doc_id", "corners", "w", "h", F.when(F.col("skipped").isNull(), quad_matrix(F.col("corners"), F.col("w"), F.col("h"))).alias("matrix"), "skipped")


def straightened(boxes: DataFrame, found: DataFrame) -> DataFrame:
    """boxes (doc_id, x, y, w, h, ...) where they are once the page is cut out; boxes of skipped pages stay."""
    moved = boxes.join(found.select("doc_id", "matrix"), "doc_id", "left").withColumn("to", F.when(F.col("matrix").isNotNull(), mapped(F.col("matrix"), *(F.col(c) for c in "xywh"))))
    return moved.select(*[F.coalesce(F.col(f"to.{c}"), F.col(c)).alias(c) if c in set("xywh") else F.col(c) for c in boxes.columns])
