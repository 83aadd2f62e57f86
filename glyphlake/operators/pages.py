"""Raster operators over pages as rows (S04, S12, S16, I04-I12, A22, W15): Arrow batches in, boxes or pages out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import raster
from .registry import Registry


def ink_boxes(pages: DataFrame, threshold: str = "otsu", axis: str | None = None) -> DataFrame:
    """Boxes of connected ink, or of horizontal (h) or vertical (v) rules, of pages (doc_id, content as PNG).

    doc_id, box_id (from 0 by y, x), x, y, w, h and error: a page that can't be read gives one row with
    its error and no box, and never ends the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    ink = raster.binary(raster.channel(raster.read_png(content or b""), "gray"), threshold)
                    found = raster.components(raster.rules(ink, axis) if axis else ink)
                    rows += [(doc_id, i, *map(int, b), None) for i, b in enumerate(found)]
                except ValueError as bad:
                    rows.append((doc_id, None, None, None, None, None, str(bad)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "box_id", "x", "y", "w", "h", "error"])

    rows = pages.select(F.col("doc_id").cast("long").alias("doc_id"), "content")
    return rows.mapInArrow(run, "doc_id long, box_id long, x int, y int, w int, h int, error string")


def drawn(boxes: DataFrame, w: int, h: int, paper: int = 230, ink: int = 20) -> DataFrame:
    """doc_id and content, a PNG of w x h pixels with the boxes (doc_id, x, y, w, h) of a page filled with ink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column(1).to_pylist():
                image = np.full((h, w), paper, np.uint8)
                for b in page:
                    image[max(0, b["y"]) : b["y"] + b["h"], max(0, b["x"]) : b["x"] + b["w"]] = ink
                out.append(raster.write_png(image))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    pages = boxes.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in "xywh"])).alias("boxes"))
    return pages.mapInArrow(run, "doc_id long, content binary")


def ink_ratios(pages: DataFrame) -> DataFrame:
    """doc_id, paper (the level of the paper) and ratio (the share of dark pixels) of pages (doc_id, content as PNG); null for a page that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for content in batch.column(1).to_pylist():
                try:
                    gray = raster.channel(raster.read_png(content or b""), "gray")
                    found.append((raster.paper_level(gray), raster.ink_ratio(gray)))
                except ValueError:
                    found.append((None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]], ["doc_id", "paper", "ratio"])

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, "doc_id long, paper double, ratio double")


STEPS = Registry("step")
STEPS.register("channel")(lambda image, name="gray": raster.channel(image, name))
STEPS.register("light")(lambda image, size=95: raster.even_light(image, size))
STEPS.register("equalize")(lambda image: raster.equalized(image))
STEPS.register("median")(lambda image, size=3: raster.median_blur(image, size))
STEPS.register("gaussian")(lambda image, size=3: np.rint(raster.gaussian(image, size)).astype(np.uint8))
STEPS.register("threshold")(lambda image, how="otsu", level=127: raster.binary(image, how, level))
STEPS.register("morphology")(lambda image, how="close", size=3: raster.morphology(image, how, size))
FINAL = "__final__"


def preprocessed(pages: DataFrame, steps: list[tuple[str, dict]], snapshots: bool = False) -> DataFrame:
    """doc_id, step, name, content (gray PNG) and error of pages (doc_id, content as PNG) after named steps of STEPS.

    One row a page, named FINAL; with snapshots also the page before each step, by number from 0. A page that
    can't be read, or on which a step fails, gives one row with its error and never ends the job.
    """
    work = [(name, STEPS.get(name), options) for name, options in steps]  # unknown names fail here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                try:
                    image = raster.read_png(content or b"")
                    for i, (name, function, options) in enumerate(work):
                        if snapshots:
                            held.append((doc_id, i, name, raster.write_png(raster.channel(image, "gray")), None))
                        image = function(image, **options)
                    held.append((doc_id, len(work), FINAL, raster.write_png(raster.channel(image, "gray")), None))
                except (KeyError, ValueError, TypeError) as bad:
                    held = [(doc_id, None, None, None, str(bad))]
                rows += held
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "step", "name", "content", "error"])

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, "doc_id long, step int, name string, content binary, error string")


def first_binary(snapshots: DataFrame) -> DataFrame:
    """doc_id and the first step before which a page is ink and paper alone, of snapshots (doc_id, step, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [content is not None and raster.is_binary(raster.read_png(content)) for content in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.bool_())], ["doc_id", "step", "binary"])

    flags = snapshots.select("doc_id", "step", "content").mapInArrow(run, "doc_id long, step int, binary boolean")
    return flags.where("binary").groupBy("doc_id").agg(F.min("step").alias("step"))
