"""Toxicity (operator 8): a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams that a text holds (present or not, so long texts don't count
more). Each is scaled by the log of the ratio of its smoothed shares in toxic and clean labelled texts, and
a logistic regression is fitted on the scaled features, in one task over a bounded sample. The model is a table
of at most 2^BITS weights; scoring is a map over the documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import tables, workers

#: Bounds of the sample that the model is fitted on: labelled rows with the smallest hash of doc_id, and whole
#: texts in that order as long as they fit into so many characters. Documents that are scored have no bound.
MAX_LABELLED = 6_000
MAX_CHARS = 32_000_000
SIZES = (3, 4, 5, 6)
BITS = 20
#: A feature is used if so many labelled texts hold it (one in SHARE of them, from 3 to LEAST_TEXTS) and the
#: log-count ratio is so far from 0.
LEAST_TEXTS, SHARE = 12, 25
LEAST_RATIO = 0.7
THRESHOLD = 0.3
#: Characters that are worked on at once; a longer text is worked on alone.
SLICE_CHARS = 1 << 18

_CHAR = np.random.default_rng(99).integers(1, 2**63, 65536, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """bias, and the hashed n-grams that are used with their weights."""

    bias: float
    names: np.ndarray
    values: np.ndarray

    def table(self) -> np.ndarray:
        """The weight of every hashed n-gram."""
        weights = np.zeros(1 << BITS, np.float32)
        weights[self.names] = self.values
        return weights


_NO_NAMES, _NO_VALUES = np.zeros(0, np.int32), np.zeros(0, np.float32)


def features(texts: list[str | None], used: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct (text, hashed n-gram) pairs of slices lo..hi of the texts, those with used[n-gram] only.

    Texts are folded to lower case; n-grams don't cross texts.
    """
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= SLICE_CHARS):
            size += len(texts[hi] or "")
            hi += 1
        some = [(t or "").lower() for t in texts[lo:hi]]
        codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum([len(t) for t in some])
        rolled = _CHAR[codes & 0xFFFF]
        base = rolled
        pairs = []
        for n in range(2, max(SIZES) + 1):
            if len(base) < n:
                break
            rolled = rolled[:-1] * _STEP + base[n - 1 :]
            if n not in SIZES:
                continue
            feature = ((rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)
            at = np.flatnonzero(used[feature]) if used is not None else np.arange(len(feature))
            doc = np.searchsorted(stops, at, side="right")
            inside = at + n <= stops[doc]
            pairs.append((doc[inside] << BITS) | feature[at[inside]])
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        yield lo, hi, both >> BITS, both & ((1 << BITS) - 1)
        lo = hi


def fit(texts: list[str | None], toxic: np.ndarray, rounds: int = 150, decay: float = 2e-4) -> Model:
    """Fits the model; without texts of both classes it gives every text the share of toxic ones."""
    n, size = len(texts), 1 << BITS
    share = float(toxic.mean()) if n else 0.0
    flat = Model(float(np.log((share * n + 0.5) / (n - share * n + 0.5))) if n else -5.0, _NO_NAMES, _NO_VALUES)
    if not n or share in (0.0, 1.0):
        return flat
    p, q = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for lo, _, doc, gram in features(texts):
        marked = toxic[doc + lo]
        p += np.bincount(gram[marked], minlength=size).astype(np.int32)
        q += np.bincount(gram[~marked], minlength=size).astype(np.int32)
    ratio = np.log((p + 1) / (toxic.sum() + 2)) - np.log((q + 1) / ((~toxic).sum() + 2))
    used = (p + q >= min(LEAST_TEXTS, max(3, n // SHARE))) & (np.abs(ratio) >= LEAST_RATIO)
    names, ratio = np.flatnonzero(used), ratio[used]
    if not len(names):
        return flat
    column = np.zeros(size, np.int32)
    column[names] = np.arange(len(names), dtype=np.int32)
    parts = [(lo, hi, doc.astype(np.int32), column[gram]) for lo, hi, doc, gram in features(texts, used)]
    target, weight, bias = toxic.astype(float), np.zeros(len(names)), flat.bias
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for k in range(1, rounds + 1):  # full-batch gradient steps with adaptive moments
        scaled, sums, error = ratio * weight, np.zeros(len(names)), np.zeros(n)
        for lo, hi, doc, at in parts:
            margin = bias + np.bincount(doc, scaled[at], minlength=hi - lo)
            error[lo:hi] = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target[lo:hi]
            sums += np.bincount(at, error[lo:hi][doc], minlength=len(names))
        slope = np.append(ratio * sums / n + decay * weight, error.mean())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        step = 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        weight, bias = weight - step[:-1], bias - float(step[-1])
    weights = (ratio * weight).astype(np.float32)
    kept = np.abs(weights) >= 1e-3
    return Model(bias, names[kept].astype(np.int32), weights[kept])


def _fit(max_chars: int) -> Callable:
    """The model of a sample (id, text, toxic): a row for each weight, and the bias as name -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("toxicity")
        rows, chars = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chars + len(row[1] or "") <= max_chars:
                    chars += len(row[1] or "")
                    rows.append(row)
        rows.sort(key=lambda row: row[0])
        model = fit([text for _, text, _ in rows], np.array([toxic for *_, toxic in rows], int) == 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(model.names, -1), pa.int32()), pa.array(np.append(model.values, model.bias), pa.float64())], ["name", "value"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS) -> Model:
    """Fits on the texts of at most max_labelled rows of labels (doc_id, toxic), the smallest hashes of doc_id.

    Labels that are null, of null ids or of ids with both labels are left out; a repeated doc_id counts once,
    with the least of its texts; a text that doesn't fit into what is left of max_chars is left out as a
    whole. Only those rows' ids are broadcast, one task fits, and only the weights reach the driver.
    """
    spark = docs.sparkSession
    tables.bounded_batches(spark)
    wanted = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.min(F.col("toxic").cast("int")).alias("_least"), F.max(F.col("toxic").cast("int")).alias("_toxic"))
        .where("_least = _toxic")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_labelled)
        .select("_id", "_toxic")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    found = texts.join(F.broadcast(wanted), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_toxic").alias("_toxic"))
    sample = found.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id").select("_id", "_text", "_toxic")
    table = tables.written(spark, sample.mapInArrow(_fit(max_chars), "name int, value double"))
    rows = table.toArrow().sort_by("name")
    tables.drop(table)
    if not rows.num_rows:  # Spark doesn't start a task over an empty table
        return fit([], np.zeros(0, bool))
    names, values = rows.column("name").to_numpy(), rows.column("value").to_numpy()
    return Model(float(values[0]), names[1:].astype(np.int32), values[1:].astype(np.float32))


def predict(model: Model, texts: list[str | None], weights: np.ndarray | None = None) -> np.ndarray:
    """Scores from 0 to 1; weights: the model's table, if it's at hand."""
    weights = model.table() if weights is None else weights
    used, out = weights != 0, np.full(len(texts), model.bias)
    for lo, hi, doc, gram in features(texts, used):
        out[lo:hi] += np.bincount(doc, weights[gram], minlength=hi - lo)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _score(model: Model) -> Callable:
    """Scores by the last column, which goes; the columns before it stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("toxicity")
        weights = model.table()
        for batch in batches:
            scores = predict(model, batch.column(batch.num_columns - 1).to_pylist(), weights)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) for each row of docs (doc_id, text).

    Rows are scored by their texts alone: repeated rows have equal scores, null ids keep their rows, null and
    empty texts get the score of no feature; an empty table gives no rows; further columns are ignored.
    """
    tables.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under the threshold, with docs' own columns, whatever their names."""
    tables.bounded_batches(docs.sparkSession)
    whole = docs.select(tables.row_of(docs), F.col("text").cast("string").alias("text"))
    scored = whole.mapInArrow(_score(model), StructType([whole.schema["row"], StructField("score", DoubleType())]))
    return scored.where(F.col("score") < threshold).select("row.*")


def held_out(doc_id: str = "doc_id"):
    """True for the rows that are never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2
