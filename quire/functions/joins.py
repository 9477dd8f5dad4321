"""Lookups whose keys may be very unevenly used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SHARDS = 64
MARKS = 1 << 26


def one_per_key(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row per key, pre-aggregated before the shuffle, as the lookup side of a join.

    Adaptive execution splits a hot key only when both join inputs come straight from an
    exchange.  An aggregate by the join keys would be joined within its own stage, so the
    keys are grouped together with a shard of themselves.  That does not change the
    groups, and it leaves the join its own exchange over the few aggregated rows.
    """
    shard = F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).alias("__shard")
    if aggregates:
        grouped = df.groupBy(*keys, shard).agg(*aggregates)
    else:
        grouped = df.select(*keys, shard).distinct()
    return grouped.drop("__shard")


def in_lookup(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: whether its key is among those of ``ids``.

    The keys set marks in a table of ``MARKS`` bits, at most 8 MB, that is broadcast.  Rows
    that meet no mark are not in ``ids`` and need no shuffle; the others, however many they
    are, are joined by the key itself.  Null keys are in no lookup.
    """
    place = F.pmod(F.xxhash64(key), F.lit(MARKS))
    word, bit = F.shiftright(place, 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    ids = ids.select(F.col(key).try_cast(df.schema[key].dataType).alias(key)).distinct()  # hashes differ by type
    marks = ids.select(word, bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    met = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    rows = df.withColumn("__word", word).join(F.broadcast(marks), "__word", "left").withColumn("__met", met).drop("__word", "__bits")
    found = rows.filter("__met").join(ids.withColumn(name, F.lit(True)), key, "left")
    both = rows.filter("NOT __met").withColumn(name, F.lit(False)).unionByName(found.withColumn(name, F.coalesce(name, F.lit(False))))
    return both.select(*df.columns, name)
