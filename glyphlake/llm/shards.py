"""Sharding (operator 13): jump consistent hashing of stable keys, in DataFrame functions only.

A key's jumps are a walk over shard numbers that is the same for every number of shards; the shard is the last number
below it. So there is no table of a ring, and with one shard more a row stays or goes to the new one. Slots number
the rows of a shard without gaps: rows are sorted over range partitions, where copies of one row differ by
their place and so never need to meet in one task, and a partition's rows are counted on from those before it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables

#: Shards of the query.
SHARDS = 16

#: Multiplier and modulus of the generator that the published algorithm draws its jumps from.
_MULTIPLIER = Decimal(2862933555777941757)
_MODULUS = Decimal(2**64)

#: What a shard's rows are numbered by; the last names rows that agree in all before.
ORDER = ("shard", "doc_id", "text_crc32", "size", "_place")


def jumps(key: Column, shards: int) -> Column:
    """shard and grown_shard (with one shard more) of an unsigned 64-bit key, a decimal, as a struct.

    Each step draws a number and jumps to floor((last + 1) * 2^31 / (its upper 31 bits + 1)); the jumps rise,
    so shards + 1 steps are enough.
    """

    def draw(at: Column) -> Column:
        return F.pmod(at * F.lit(_MULTIPLIER) + F.lit(1), F.lit(_MODULUS)).cast("decimal(20,0)")

    def step(at: Column, _: Column) -> Column:
        """Takes the jump that was drawn for and draws again; nothing once the jumps have passed the shards."""
        upper = F.call_function("div", at["drawn"], F.lit(Decimal(2**33))) + 1
        jumped = F.floor((at["next"] + 1) * (F.lit(float(2**31)) / upper.cast("double")))
        moved = F.struct(
            F.when(at["next"] < shards, at["next"]).otherwise(at["shard"]).alias("shard"),
            at["next"].alias("grown_shard"),
            jumped.alias("next"),
            draw(at["drawn"]).alias("drawn"),
        )
        return F.when(at["next"] <= shards, moved).otherwise(at)

    nothing = F.lit(0).cast("long")
    start = F.struct(nothing.alias("shard"), nothing.alias("grown_shard"), nothing.alias("next"), draw(key).alias("drawn"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.struct(done["shard"].cast("int").alias("shard"), done["grown_shard"].cast("int").alias("grown_shard"))


def key_of(doc_id: Column) -> Column:
    """An unsigned 64-bit key as a decimal: the first 16 hex digits of the SHA-256 of the decimal id (null: of nothing)."""
    digits = F.sha2(F.coalesce(doc_id.cast("string"), F.lit("")), 256)
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("decimal(20,0)")
    return (half(1) * F.lit(Decimal(2**32)) + half(9)).cast("decimal(20,0)")


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and grown_shard of each row of docs (doc_id, text), and the whole row as `row`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        tables.row_of(docs),
    )
    return placed.withColumn("jumps", jumps(key_of(F.col("doc_id")), shards)).select("doc_id", "size", "text_crc32", "jumps.shard", "jumps.grown_shard", "row")


def number(placed: DataFrame) -> DataFrame:
    """Adds slot: the rows of each shard counted from 0 in the order of doc_id (null first), text_crc32 and size.

    The rows are sorted over range partitions and written; what is gathered is one row for each shard and partition.
    """
    order = [F.col(c) for c in ORDER]
    sorted_rows = placed.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    table = tables.written(placed.sparkSession, sorted_rows.drop("_place").withColumn("_at", F.monotonically_increasing_id()))
    rows = table.withColumn("_part", F.shiftright("_at", 33))
    counted = rows.groupBy("shard", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    # at most a row for each range partition and shard: bounded by spark.sql.shuffle.partitions, not by the data
    numbered = rows.join(F.broadcast(offsets), ["shard", "_part"])
    return numbered.withColumn("slot", F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of each row of docs (doc_id, text), by the law `key`.

    Returns doc_id, size (UTF-8 bytes of the text, null: none, and 1), text_crc32, law, shard, slot and grown_shard.
    Rows of one doc_id, null too, are in one shard, repeated rows included; each has its own slot. Rows
    that agree in doc_id, text_crc32 and size have neighbouring slots in any order. An empty table gives no
    rows; further columns don't matter.
    """
    placed = number(place(docs, shards).drop("row"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes docs as Parquet files, a folder `shard=` for each shard, with the column slot; columns shard and slot of docs give way."""
    numbered = number(place(docs, shards).select("doc_id", "size", "text_crc32", "shard", "row"))
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    kept = [F.col("row")[c].alias(c) for c in own]
    numbered.select(*kept, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
