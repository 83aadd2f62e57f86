"""Steps on all rows of a page at once, as NumPy over many pages side by side.

`by_page` sorts rows by page where they lie and hands whole pages to a function. What windows, groups and joins do one
after the other, each with its own sort and its own copy of the rows, are sorts and running sums of plain arrays here.
Coordinates are doubles, and a null is NaN: no comparison with it holds, as in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are handed on together, if pages end there: a page is never cut, however long it is.
ROWS = 2**17

#: From the rows of whole pages, the page of each row (from 0, ascending) and the doc_id of each page to rows of the result.
Kernel = Callable[[pa.Table, np.ndarray, pa.ChunkedArray], pa.Table]


def by_page(rows: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """What kernel makes of the pages (doc_id) of rows. Rows that are dealt out by doc_id stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, enough = [], 0, ROWS

        def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
            first = table["_at"].to_numpy() == 1
            page = np.cumsum(first) - 1
            yield from kernel(table, page, table["doc_id"].take(pa.array(np.flatnonzero(first)))).to_batches()

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(table["_at"].to_numpy() == 1)[-1])
            if last:
                yield from made(table.slice(0, last).combine_chunks())
            table = table.slice(last)
            held, count = table.to_batches(), table.num_rows
            enough = max(ROWS, 2 * count)  # a long page isn't looked through for each batch
        if count:
            yield from made(pa.Table.from_batches(held).combine_chunks())

    at = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lit(0)))
    return rows.withColumn("_at", at).mapInArrow(run, schema)


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as doubles, null as NaN."""
    return [pc.cast(table[n], pa.float64()).to_numpy() for n in names]


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the row before it in a key."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def gap_groups(page: np.ndarray, at: np.ndarray, tie: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """The order by page and place, and in that order the number of the cluster, over all pages. Nulls come first and part nothing."""
    order = np.lexsort((tie, at, ~np.isnan(at), page))
    far = starts_of(page[order])
    far[1:] |= np.diff(at[order]) > gap
    return order, np.cumsum(far) - 1


def medians(group: np.ndarray, value: np.ndarray, n: int = 0) -> np.ndarray:
    """The median of the values of each group (from 0 to n at least) that aren't null; NaN without one."""
    n = max(n, int(group.max(initial=-1)) + 1)
    ranked = value[np.lexsort((value, group))]  # NaN last
    many = np.bincount(group[~np.isnan(value)], minlength=n)
    first = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n))])[:-1]
    some = np.maximum(many, 1)
    at = lambda k: ranked[np.minimum(first + k, len(ranked) - 1)]
    return np.where(many > 0, (at((some - 1) // 2) + at(some // 2)) / 2, np.nan) if len(ranked) else np.full(n, np.nan)


def stacked(group: np.ndarray, ids: np.ndarray, x: np.ndarray, w: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Whether a blob's width overlaps another one of its group by a share of the shorter or more; a sweep along x."""
    order = np.lexsort((x, group))
    g, i, x, w = group[order], ids[order], x[order], w[order]
    right, met = x + w, np.zeros(len(x), bool)
    last = np.flatnonzero(np.append(starts_of(g)[1:], True)) if len(g) else np.zeros(0, int)
    end = last[np.searchsorted(last, np.arange(len(g)))]
    alive, step = np.arange(len(x)), 1
    while len(alive):
        alive = alive[alive + step <= end[alive]]
        alive = alive[x[alive + step] <= right[alive]]
        other = alive + step
        both = np.minimum(right[alive], right[other]) - np.maximum(x[alive], x[other])
        hit = (both >= share * np.minimum(w[alive], w[other])) & (i[alive] != i[other])
        met[alive[hit]] = met[other[hit]] = True
        if step & (step - 1) == 0:  # a blob that is met and has none behind it that isn't is done
            open_ = np.cumsum(~met)
            alive = alive[~met[alive] | (open_[end[alive]] > open_[alive])]
        step += 1
    out = np.zeros(len(x), bool)
    out[order] = met
    return out


Sides = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def near(page: np.ndarray, boxes: Sides) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of two boxes (left, right, top, bottom) of one page that meet or touch along one axis, each pair once: candidates for a test.

    A sweep along the axis on which the boxes of a page overlap less.
    """
    x0, x1, y0, y1 = boxes
    n = int(page.max()) + 1 if len(page) else 0
    crowd = []
    for lo, hi in ((x0, x1), (y0, y1)):
        least, most = np.full(n, np.inf), np.full(n, -np.inf)
        np.fmin.at(least, page, lo)
        np.fmax.at(most, page, hi)
        crowd.append(np.bincount(page, np.nan_to_num(hi - lo), n) / np.maximum(most - least, 1))
    down = crowd[1][page] < crowd[0][page] if n else np.zeros(0, bool)
    lo, hi = np.where(down, y0, x0), np.where(down, y1, x1)
    order = np.lexsort((lo, page))
    page, lo, hi = page[order], lo[order], hi[order]
    alive, step = np.arange(len(page)), 1
    while len(alive):
        alive = alive[alive + step < len(page)]
        other = alive + step
        ahead = (page[other] == page[alive]) & (lo[other] <= hi[alive])
        alive = alive[ahead]
        if len(alive):
            yield order[alive], order[alive + step]
        step += 1


def meeting(page_a: np.ndarray, a: Sides, page_b: np.ndarray, b: Sides) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of boxes of a and of b of one page that meet or touch along one axis: candidates for a test."""
    n = len(page_a)
    for p, q in near(np.concatenate([page_a, page_b]), tuple(np.concatenate([c, d]) for c, d in zip(a, b, strict=True))):
        differ = (p < n) != (q < n)
        p, q = p[differ], q[differ]
        yield np.minimum(p, q), np.maximum(p, q) - n


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that pairs (a, b) lead to from each of n."""
    root = np.arange(n)
    while True:
        least = root.copy()
        p, q = root[a], root[b]
        np.minimum.at(least, p, q)
        np.minimum.at(least, q, p)
        least = least[least]
        if np.array_equal(least, root):
            return root
        root = least
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]


def mean_groups(page: np.ndarray, at: np.ndarray, tie: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by page and place, and in that order the cluster (from 0 on each page): a row joins the last one within reach of its mean.

    As in `cluster.mean_clusters` a row further than reach from the row before it starts a cluster whatever the mean is;
    the islands between are folded side by side.
    """
    order = np.lexsort((tie, at, ~np.isnan(at), page))
    page, at, reach = page[order], at[order], reach[order]
    first = starts_of(page)
    begins = first.copy()
    begins[1:] |= np.diff(at) > reach[1:] + 1e-6
    start = np.flatnonzero(begins)
    size = np.diff(np.append(start, len(at)))
    long = np.argsort(-size, kind="stable")
    start, size = start[long], size[long]
    total, many = at[start], np.ones(len(start))
    for k in range(1, int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k))
        i = start[:live] + k
        total, many = total[:live], many[:live]
        joins = np.abs(at[i] - total / many) <= reach[i]
        begins[i] = ~joins
        total, many = np.where(joins, total, 0) + at[i], np.where(joins, many, 0) + 1
    cluster = np.cumsum(begins) - 1
    return order, cluster - cluster[np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else cluster


def numbered(*keys: np.ndarray) -> np.ndarray:
    """The place (from 0) of each row within its equal rows of keys, which are in order."""
    first = starts_of(*keys)
    return np.arange(len(first)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, int)


def sides(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> Sides:
    return x, x + w, y, y + h
