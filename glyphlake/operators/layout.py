"""Zones and column roles of form pages (P09, P10, P11, the buckets of W13, the nearest column of R20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE_TOLERANCE = 10
# Shapes of cells: smallest sides, least width for a height, largest shares of the page.
MIN_SIDE, MIN_HEIGHT, LEAST_RATIO, MOST_AREA, MOST_WIDTH = 15, 20, 0.3, 0.2, 0.6


def is_cell(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Boxes that can be cells of a table."""
    return (w >= MIN_SIDE) & (h >= MIN_SIDE) & (h >= MIN_HEIGHT) & (w / h >= LEAST_RATIO) & (w * h <= MOST_AREA * page_w * page_h) & (w <= MOST_WIDTH * page_w)


def zone_of(center_y: Column, top: Column, bottom: Column, tolerance: int = ZONE_TOLERANCE) -> Column:
    """Above, inside or below a table; unknown without a table."""
    return (
        F.when(top.isNull() | bottom.isNull(), "unknown")
        .when(center_y < top - tolerance, "header")
        .when(center_y > bottom + tolerance, "footer")
        .otherwise("table")
    )


def bucket(fraction: Column, n: Column) -> Column:
    """The buckets of W13: the position of a fraction of the page width among n equal parts."""
    return F.least(F.lit(n - 1), F.floor(fraction * n)).cast("int")


def label_columns(cells: DataFrame, template: DataFrame, roles: list[str], reach: float = 0.4) -> DataFrame:
    """The nearest column of R20, J14: doc_id, row, cell_id and role of cells (doc_id, row, cell_id, x, w): that of the nearest template column.

    template has doc_id, ordinal and center for each column; a cell further than `reach` average column
    distances from all is unknown. roles are those of the ordinals.
    """
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    spacing = template.withColumn("_d", F.col("center") - F.lag("center").over(order)).groupBy("doc_id").agg(F.avg("_d").alias("spacing"))
    names = F.create_map(*[F.lit(x) for i, r in enumerate(roles) for x in (i, r)])
    pairs = cells.join(template.hint("merge"), "doc_id").withColumn("far", F.abs(F.col("x") + F.col("w") / 2 - F.col("center")))
    best = pairs.groupBy("doc_id", "row", "cell_id").agg(F.min(F.struct("far", "ordinal")).alias("b"))
    near = best.join(spacing.hint("merge"), "doc_id").withColumn("_in", F.col("b.far") <= reach * F.coalesce("spacing", F.lit(float("inf"))))
    return near.select("doc_id", "row", "cell_id", F.when(F.col("_in"), F.coalesce(F.try_element_at(names, F.col("b.ordinal")), F.lit("unknown"))).otherwise("unknown").alias("role"))
