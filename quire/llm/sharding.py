"""Sharding by a hierarchical weighted hash tree: regions, racks, shards.

A row descends level by level.  Every child of the node that it has reached draws a number
for it, minus the logarithm of a uniform hash of the row's key and the child, divided by
the weight of all shards below the child; the row goes to the smallest draw.  That is one
draw for each child on the way and not for each shard.

A draw depends on the row's key, the node and the node's weight alone.  So a changed
weight moves rows only into or out of the subtrees that hold the changed shard: between
other regions, other racks of its region and other shards of its rack nothing moves.  A
shard that opens a region takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARDS = 40
RACK = 4
REGION = 2
#: Expected rows of the groups in which slots are numbered.
GROUP_ROWS = 1_000
_OVERHEAD = 16


def row_key(doc_id: Column, text_crc32: Column, size: Column) -> Column:
    """A hash of the id; rows without id are told apart by their text."""
    return F.when(doc_id.isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(text_crc32, size, F.lit(1)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _child(key: Column, level: int, first: Column, n: int, weights: Sequence[float]) -> Column:
    """Of the ``n`` nodes of a level from ``first`` on, the one with the smallest draw."""
    table = F.array(*[F.lit(float(w)) for w in weights])

    def draw(node: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node), 11) + 0.5) / float(1 << 53)
        weight = F.coalesce(F.get(table, node), F.lit(0.0))
        return F.struct(F.when(weight > 0, -F.log(uniform) / weight).otherwise(float("inf")).alias("draw"), node.alias("node"))

    return F.array_min(F.transform(F.sequence(first, first + (n - 1)), draw))["node"]


def descend(key: Column, weights: Sequence[float], rack: int = RACK, region: int = REGION) -> Column:
    """The shard that a row reaches.

    Shards are numbered through racks of ``rack``, and racks through regions of ``region``;
    the last ones may have fewer.  Shards without weight get no rows.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight")
    racks = [sum(weights[k : k + rack]) for k in range(0, len(weights), rack)]
    regions = [sum(racks[k : k + region]) for k in range(0, len(racks), region)]

    def below(x: Column, r: Column) -> Column:
        return _let(_child(x, 1, r * region, region, racks), lambda k: _child(x, 2, k * rack, rack, weights))

    return _let(key, lambda x: _let(_child(x, 0, F.lit(0), len(regions), regions), lambda r: below(x, r)))


def shard_rows(docs: DataFrame, weights: Sequence[float] | int = SHARDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``weights`` holds one weight for each shard, or is their number.  size is the UTF-8
    bytes of the text plus 16, null texts having none and the checksum of no bytes.
    slot numbers the rows of a shard from 0 without gaps; rows are numbered in groups of
    bounded expected size, behind the sum of the groups before, so no task sees a whole
    shard.  Rows that repeat an id share its shard.  grown_shard is the shard in a tree with
    one more of weight 1.  An empty table gives an empty result; other columns are not read.
    """
    each = [1.0] * weights if isinstance(weights, int) else list(weights)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + _OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    groups = max(1, -(-docs.count() // (len(each) * group_rows)))
    key = F.col("key")
    placed = rows.select("doc_id", "size", "text_crc32", "key", descend(key, each).alias("shard"), descend(key, [*each, 1.0]).alias("grown_shard"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("key", "text_crc32", "size", F.lit(2)), F.lit(groups)))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select("shard", "part", (F.sum("rows").over(before) - F.col("rows")).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("place", place).join(starts, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
        "grown_shard",
    )
