"""Filter interaction audit (operator 12): what five filters do to a corpus in every order of applying them.

A relational word pipeline: words are exploded, counted for each (text, word), then for each text, and outer-joined to
the flags that need no words. Each row then has a mask of the filters it fails. For each part, conditional counts over
the 32 masks say all there is to know: every order's numbers are sums of them.
"""

from __future__ import annotations

import itertools
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

#: The filters, by bit: few words, few distinct words, many capitals, symbols, copy of a smaller doc_id.
FILTERS = "ABCDE"

#: White space between words, and symbols that filter D looks for.
_SPACE = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "[#$%&*|]"


def word_totals(rows: DataFrame) -> DataFrame:
    """copy, n_words and n_distinct of each text that has words; rows: copy (a text's hash) and text.

    Each text counts once, however many rows have it. Texts are dealt out by copy; the two aggregates of
    words keep that partitioning, so words are never shuffled.
    """
    once = rows.groupBy("copy").agg(F.first("text").alias("text"))
    words = once.select("copy", F.explode(F.split("text", _SPACE)).alias("word")).where(F.col("word") != "")
    per_word = words.groupBy("copy", "word").agg(F.count(F.lit(1)).alias("n"))
    return per_word.groupBy("copy").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit i: fails FILTERS[i]) of each row of docs (doc_id, text, lang).

    A null text is empty. A row fails E if a row of smaller doc_id has the same text; rows of equal doc_id don't
    make each other fail, and a null doc_id is neither smaller nor larger than others. A null lang is the part "".
    All but E and the part follow from the text alone, so texts are judged and rows look their text's verdict up.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("copy", F.unhex(F.sha2("text", 256)))
    capitals = F.length("text") - F.length(F.translate("text", string.ascii_uppercase, ""))
    told = lambda flag: F.max(flag.cast("int"))
    flags = rows.groupBy("copy").agg(F.min("doc_id").alias("least"), told(100 * capitals > 3 * F.length("text")).alias("c"), told(F.col("text").rlike(_SYMBOLS)).alias("d"))
    n, k = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    bits = [n < 200, 100 * k < 50 * n, F.col("c"), F.col("d")]
    alone = sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))
    # written, so that the join below has a plain exchange on either side and a hot text's rows can be split
    judged = tables.written(docs.sparkSession, flags.join(word_totals(rows.select("copy", "text")), "copy", "left").select("copy", "least", alone.alias("alone")))
    fails_e = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    mask = F.col("alone") + fails_e.cast("int") * (1 << FILTERS.index("E"))
    return rows.drop("text").join(judged, "copy").select("doc_id", "part", mask.alias("mask"))


def _labelled(labels: DataFrame) -> DataFrame:
    """One row for each labelled doc_id; of several rows of an id, one that says so is enough."""
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where(F.col("doc_id").isNotNull())
    return named.groupBy("doc_id").agg(said("quality"), said("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and for each of the 32 masks the rows of the part that have it: all (n0..), good (good0..) and toxic ones (toxic0..)."""
    labelled = tables.written(docs.sparkSession, _labelled(labels))
    rows = failures(docs).join(labelled, "doc_id", "left")
    told = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    by_mask = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), told("quality").alias("good"), told("toxic").alias("toxic"))
    masks = range(1 << len(FILTERS))
    return by_mask.groupBy("part").agg(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).alias(f"{c}{m}") for c in ("n", "good", "toxic") for m in masks])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, for each part of docs (doc_id, text, lang).

    Returns part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.
    Rows count alone, repeated rows and null ids too (`failures` says how). Rows without a label are neither good
    nor toxic. An empty table has no parts, so it gives no rows; further columns don't matter.
    """
    masks = range(1 << len(FILTERS))
    arrays = [F.array(*[F.col(f"{c}{m}") for m in masks]).alias(c) for c in ("n", "good", "toxic")]
    every = " ".join(map("".join, itertools.permutations(FILTERS)))
    ordered = mask_counts(docs, labels).select("part", *arrays, F.explode(F.split(F.lit(every), " ")).alias("filter_order"))
    steps = ordered.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    placed = steps.withColumns(
        {
            "filter": F.substring("filter_order", F.col("step"), F.lit(1)),
            "before": F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda a, i: a + F.when(i < F.col("step"), bit_of(F.substring("filter_order", i, F.lit(1)))).otherwise(0)),
        }
    ).withColumn("bit", bit_of(F.col("filter")))
    before, bit = F.col("before"), F.col("bit")

    def total(counts: str, holds, weight=lambda m: F.lit(1)) -> Column:
        """Sum of the counts of masks for which holds."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(masks) - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(holds(m), F.get(F.col(counts), m) * weight(m)).otherwise(0))

    fails, earlier = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    removed = lambda counts: total(counts, lambda m: fails(m) & ~earlier(m))
    orders = len(every.split())
    return placed.select(
        "part",
        "filter_order",
        "step",
        "filter",
        total("n", lambda m: m.bitwiseAND(before + bit) == 0).alias("kept"),
        removed("n").alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.get("n", bit).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        # of the filters that a row fails, each is the first one in an equal share of the orders
        total("n", fails, lambda m: F.call_function("div", F.lit(orders), F.bit_count(m))).alias("shapley"),
    )
