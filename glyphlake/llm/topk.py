"""Exact top-k search by inner product (operator 7): a pivot-distance index over integer vectors.

Vectors are quantised to floor(scale * x). One extra coordinate makes all of one length, so that the largest
inner product is the least Euclidean distance, a metric. Each vector is keyed by its nearest pivot (its
cell) and its distance from it, and cells are cut into blocks of bounded size.

A query starts in one block of its own cell, which gives k scores to beat. The triangle inequality then
leaves, in each block, the annulus of vectors whose distance from the pivot is near enough to the query's.
The query is sent to the blocks whose annulus isn't empty. There it is read outwards from the query's own
distance, a chunk at a time, until no vector further out can beat the k-th score. Bounds are widened by a
relative margin, so rounding never drops a vector; scores are exact integers.

A task holds one block; the queries that reach it pass by in batches. Blocks are copied only for each
QUERY_ROWS queries, so that a block that all queries reach is worked on by several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables

SCALE = 64
TOP = 20
#: Pivots: a quarter of the square root of the number of vectors, within these bounds; those with the smallest hash.
PIVOTS = (64, 1024)
BLOCK_ROWS = 8192
QUERY_ROWS = 65_536
CHUNK = 2048
#: Above this sum of products a double isn't exact, and Python's integers are used.
EXACT = float(2**52)


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE, *passed: str) -> DataFrame:
    """vec_id and q, floor(scale * x) as doubles, of vectors without null or non-finite components, and columns that pass; others and null ids are left out."""
    x = F.col(vector_column)
    finite = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & finite)
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("q"), *passed)


def _norms(q: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, q)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // len(column)) if len(column) else np.zeros((0, 0))


def _place(pivots: np.ndarray, longest: float) -> Callable:
    """Vectors (row, vec_id, q, is_query) with their cell and distance from its pivot; pivots have the extra coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(2))
            extra = np.sqrt(np.maximum(longest - _norms(q), 0))
            square = longest + _norms(pivots)[None, :] - 2 * (q @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1])
            cell = square.argmin(1)
            far = np.sqrt(np.maximum(square[np.arange(len(q)), cell], 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return run


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of each row of a with each of b as integers; doubles if these are exact."""
    bound = a.shape[1] * (np.abs(a).max(initial=0) * np.abs(b).max(initial=0))
    if bound < EXACT:
        return a @ b.T
    whole = [[int(v) for v in row] for row in a], [[int(v) for v in row] for row in b]
    return np.array([[sum(x * y for x, y in zip(u, v, strict=True)) for v in whole[1]] for u in whole[0]], object).reshape(len(a), len(b))


def _least(score: float, scores: np.ndarray) -> float:
    """What scores are compared with to be at least score: a little less where doubles aren't exact."""
    return score if scores.dtype != object else score - 1e-6 - 1e-12 * abs(score)


class _Block:
    """The vectors of a block, by distance from the pivot."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        row, ids, q, far, cell = (np.concatenate([p[k] for p in parts]) for k in range(5))
        order = np.lexsort((ids, far))
        self.row, self.ids, self.q, self.far, self.cell = row[order], ids[order], q[order], far[order], int(cell[0])


_KEYS = ["cell", "block", "part"]
_MET = "cell int, block int, part int, kind int, row long, vec_id long, q array<double>, number double"


def _meet(vectors: DataFrame, queries: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(block, rows, ids, vectors and numbers of queries) for the queries of each (cell, block, part), a batch at a time.

    vectors and queries have the columns of _MET; number is the distance from the pivot, or what a query has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)], 1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                some, kind = batch.slice(lo, hi - lo), int(keys[lo, 3])
                if key != tuple(keys[lo, :3]):
                    key, parts, block = tuple(keys[lo, :3]), [], None
                row, ids, number = (some.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 7))
                q = _matrix(some.column(6))
                if kind == 0:
                    parts.append((row, ids, q, number, keys[lo:hi, 0]))
                elif parts:
                    block = block or _Block(parts)
                    yield work(block, row, ids, q, number)

    both = vectors.select(*[c.split()[0] for c in _MET.split(", ")]).unionByName(queries)
    return both.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "kind").mapInArrow(run, schema)


def _start(k: int) -> Callable:
    """The k-th score of each query in one block of its cell (null: fewer)."""

    def work(block: _Block, row: np.ndarray, ids: np.ndarray, q: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        kth = []
        for i in range(len(row)):
            scores = _exact(q[i : i + 1], block.q)[0]
            scores = scores[block.row != row[i]].astype(float)
            kth.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(kth, pa.float64())], ["row", "kth"])

    return work


def _search(k: int, pivots: np.ndarray, longest: float) -> Callable:
    """Vectors of one block that can be among a query's k best."""
    slack = 1e-9 * (longest + 1)

    def work(block: _Block, row: np.ndarray, ids: np.ndarray, q: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        pivot, far = pivots[block.cell], block.far
        squares = _norms(q)
        away = np.sqrt(np.maximum(squares + pivot @ pivot - 2 * (q @ pivot[:-1]), 0))
        out = []
        for i, (own, kth) in enumerate(zip(row, number, strict=True)):

            def radius(score: float, i: int = i) -> float:
                """Distance of a vector with that score; further ones score less."""
                return math.sqrt(max(squares[i] + longest - 2 * score, 0) + slack + 1e-9 * squares[i]) * (1 + 1e-9)

            bound = -math.inf if np.isnan(kth) else float(kth)
            lo, hi, reach = 0, len(far), math.inf
            at, scores = np.zeros(0, np.int64), None
            if bound > -math.inf:
                reach = radius(bound)
                lo, hi = int(np.searchsorted(far, away[i] - reach, "left")), int(np.searchsorted(far, away[i] + reach, "right"))
            left = right = int(np.clip(np.searchsorted(far, away[i]), lo, hi))
            while left > lo or right < hi:
                a, b = max(lo, left - CHUNK), min(hi, right + CHUNK)
                for x, y in ((a, left), (right, b)):
                    if x < y:
                        found = _exact(q[i : i + 1], block.q[x:y])[0]
                        hits = np.flatnonzero(found >= _least(bound, found))
                        hits = hits[block.row[x + hits] != own]
                        if len(hits):
                            at = np.append(at, x + hits)
                            found = found[hits]
                            scores = found if scores is None else np.append(scores, found)
                left, right = a, b
                if len(at) > k:
                    best = np.lexsort((block.ids[at], -scores))[:k]
                    at, scores = at[best], scores[best]
                if len(at) == k and (least := float(min(scores))) > bound:
                    bound = least
                    reach = min(reach, radius(bound))
                    lo = max(lo, int(np.searchsorted(far, away[i] - reach, "left")))
                    hi = min(hi, int(np.searchsorted(far, away[i] + reach, "right")))
                    left, right = max(left, lo), min(right, hi)
            if len(at):
                out.append((np.full(len(at), own), np.full(len(at), ids[i]), block.row[at], block.ids[at], [max(-(2**63), min(2**63 - 1, int(s))) for s in scores]))
        names = ["query", "query_id", "row", "vec_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *[o[c] for o in out]]).astype(np.int64)) for c in range(5)], names)

    return work


def search(vectors: DataFrame, is_query, k: int = TOP, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows for each row where is_query holds.

    Scores are inner products of floor(scale * x), held within a long's range; ties go to the smaller vec_id.
    Vectors that are null or hold null or non-finite components, and null ids, take no part; so do vectors of
    another length than the most frequent one (of equals the longest). Rows of one vec_id are rows like
    others: each is found, and each asks for itself, whose answers then carry the same query_id. Fewer than k
    other rows are all returned; an empty table gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    tables.bounded_batches(spark)
    wide = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    # rows are numbered as they are written, so a later task that runs again sees the same numbers
    rows = tables.written(spark, quantised(wide, "id", "v", scale, "is_query").withColumn("row", F.monotonically_increasing_id()))
    lengths = rows.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("q") == lengths[0]["d"])
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)
    longest = float(rows.agg(F.max(square)).collect()[0][0])
    wanted = min(max(math.isqrt(lengths[0]["count"]) // 4, PIVOTS[0]), PIVOTS[1])
    heads = rows.orderBy(F.xxhash64("row"), "row").limit(wanted).select("q").collect()
    pivots = np.array([r["q"] for r in heads], float)
    pivots = np.hstack([pivots, np.sqrt(np.maximum(longest - _norms(pivots), 0))[:, None]])
    placed = tables.written(
        spark, rows.select("row", "vec_id", "q", "is_query").mapInArrow(_place(pivots, longest), "row long, vec_id long, q array<double>, is_query boolean, cell int, far double")
    )
    # blocks of a cell: their number follows its size, so that each has about BLOCK_ROWS vectors
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("near_end"), F.max("far").alias("far_end"), F.count_if("is_query").alias("queries")).collect()
    sizes = {r["cell"]: (-(-r["n"] // BLOCK_ROWS), r["near_end"], r["far_end"]) for r in cells}
    count = F.create_map(*[F.lit(x) for c, s in sizes.items() for x in (c, s[0])])
    parts = max(1, -(-sum(r["queries"] for r in cells) // QUERY_ROWS))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.element_at(count, F.col("cell"))).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part") if parts > 1 else F.lit(0).alias("part")
    blocks = placed.select("row", "vec_id", "q", "cell", block.alias("block"), F.lit(0).alias("kind"), F.col("far").alias("number"), spread)
    part = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(parts)).cast("int").alias("part")
    queries = placed.where("is_query").select("row", "vec_id", "q", "cell", F.lit(0).alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("number"), part)
    # each query meets a block of its cell
    started = _meet(blocks.where("block = 0"), queries, _start(k), "row long, kth double")
    begun = tables.written(spark, queries.select("row", "vec_id", "q", "part").join(started, "row", "left").repartition("row"))
    # and then the blocks that its annulus reaches
    reached = begun.select("row", "vec_id", "q", "part", "kth").mapInArrow(_reach(pivots, longest, sizes), _MET)
    seen = _meet(blocks, reached, _search(k, pivots, longest), "query long, query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return seen.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reach(pivots: np.ndarray, longest: float, sizes: dict[int, tuple[int, float, float]]) -> Callable:
    """The blocks whose vectors the triangle inequality doesn't rule out, for each query (row, vec_id, q, part, kth)."""
    cells = np.array(sorted(sizes))
    near, far, count = (np.array([sizes[c][i] for c in cells.tolist()]) for i in (1, 2, 0))
    at, slack = pivots[cells], 1e-9 * (longest + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                q, kth = _matrix(some.column(2)), some.column(4).to_numpy(zero_copy_only=False).astype(float)
                squares = _norms(q)
                away = np.sqrt(np.maximum(squares[:, None] + _norms(at)[None, :] - 2 * (q @ at[:, :-1].T), 0))
                reach = np.where(np.isnan(kth), np.inf, np.sqrt(np.maximum(squares + longest - 2 * np.nan_to_num(kth), 0) + slack + 1e-9 * squares) * (1 + 1e-9))
                row, col = np.nonzero((away + reach[:, None] >= near) & (away - reach[:, None] <= far))
                times = count[col]
                row, col = np.repeat(row, times), np.repeat(col, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for a in range(0, len(row), 4096):  # batches of bounded size, however many blocks there are
                    own = pa.array(row[a : a + 4096])
                    take = [some.column(k).take(own) for k in (0, 1, 2, 3, 4)]
                    ints = lambda v, a=a: pa.array(v[a : a + 4096].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([ints(cells[col]), ints(block), take[3], pa.array(np.ones(len(own), np.int32)), take[0], take[1], take[2], take[4]], [c.split()[0] for c in _MET.split(", ")])

    return run
