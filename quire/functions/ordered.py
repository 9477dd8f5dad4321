"""Ordered work inside a document that holds when one document is most of the data.

Element positions are 32-bit integers.  A window over a whole document would put all
of it into one task, so running values are computed in two steps: inside blocks of
``block`` positions, and over one summary row per block.  A document has at most
2**31 / block summary rows, which bounds the second step whatever the data size.
String building follows the same idea: a body is a row for each segment of ``rows``
positions, and the segments of a document in order, joined by the body's separator, are
the whole body.  The form is the same for short and long documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

BLOCK = 4096
SEGMENT_ROWS = 1_000
#: Fewer where pictures are embedded, so that a segment of large ones fits a row.
IMAGE_SEGMENT_ROWS = 64
SALTS = 64

_KEY = "__key"


def _block_key(keys: Sequence[str], order: str, block: int) -> Column:
    """Key and block as one struct, which is never NULL, so rows without a key are kept."""
    return F.struct(*keys, block_of(order, block).alias("__block")).alias(_KEY)


def block_of(order: str, size: int) -> Column:
    return F.expr(f"`{order}` div {int(size)}").cast("int")


def _earlier_blocks(keys: Sequence[str]) -> WindowSpec:
    by = Window.partitionBy(*[F.col(f"{_KEY}.`{k}`") for k in keys])
    return by.orderBy(F.col(f"{_KEY}.__block")).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    inclusive: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the same key."""
    keys = list(keys)
    blocked = df.withColumn(_KEY, _block_key(keys, order, block)).withColumn("__value", value.cast("long"))
    before = _earlier_blocks(keys)
    sums = blocked.groupBy(_KEY).agg(F.sum("__value").alias("__sum"))
    bases = sums.select(_KEY, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    last = 0 if inclusive else -1
    local = Window.partitionBy(_KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    return (
        blocked.join(bases, _KEY)
        .withColumn(name, F.col("__base") + F.coalesce(F.sum("__value").over(local), F.lit(0)))
        .drop(_KEY, "__value", "__base")
    )


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column | dict[str, Column],
    name: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``name``: the latest non-NULL ``value`` in an earlier row of the same key.

    ``value`` may be several values by name, which then share their passes.
    """
    keys = list(keys)
    values = value if isinstance(value, dict) else {name: value}
    held = {n: f"__value_{k}" for k, n in enumerate(values)}
    blocked = df.withColumn(_KEY, _block_key(keys, order, block)).select("*", *[v.alias(held[n]) for n, v in values.items()])
    # One row per block, also for blocks without a value, so that each has its carry.
    tails = blocked.groupBy(_KEY).agg(
        *[F.max_by(h, F.when(F.col(h).isNotNull(), F.col(order))).alias(h) for h in held.values()]
    )
    before = _earlier_blocks(keys)
    carry = tails.select(_KEY, *[F.last(h, ignorenulls=True).over(before).alias(f"__carry{h}") for h in held.values()])
    local = Window.partitionBy(_KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.coalesce(F.last(h, ignorenulls=True).over(local), F.col(f"__carry{h}")).alias(n) for n, h in held.items()]
    return blocked.join(carry, _KEY).select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *latest)


def ordered_join(order: Column, part: Column, sep: str) -> Column:
    """Aggregate: the parts of a group in order, NULL parts left out; NULL without any.

    A group without parts is no empty part: joined with its neighbours it must not leave a
    separator behind.
    """
    pairs = F.collect_list(F.when(part.isNotNull(), F.struct(order.alias("o"), part.alias("p"))))
    parts = F.transform(F.sort_array(pairs), lambda x: x["p"])
    return F.when(F.count(part) > 0, F.array_join(parts, sep))


def assemble(
    parts: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, str],
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Join string columns in order into bodies, one row per key and segment.

    ``columns`` maps each part column to its separator.  Joining the segments of a key
    in order with the same separator gives the whole body.  A segment in which nothing is
    shown has no row.
    """
    segment = block_of(order, rows).alias("segment")
    shown = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    return (
        parts.filter(shown)
        .groupBy(*keys, segment)
        .agg(*[ordered_join(F.col(order), F.col(c), sep).alias(c) for c, sep in columns.items()])
    )


def mark_long(df: DataFrame, part: str, elements: DataFrame, rows: int) -> DataFrame:
    """Add ``__long``, true for rows of documents that reach position ``rows``, else NULL.

    ``part`` is the number of the row's block of ``rows`` positions.  The list of long
    documents comes from a filter on the position that reaches the scan; while it is
    empty, adaptive execution drops the join.  The join is salted by part, so that one
    document is not sent to one task, and a long document is listed no more often than
    it has parts.
    """
    last = F.least(F.max(block_of("element_index", rows)), F.lit(SALTS - 1))
    long = (
        elements.filter(F.col("element_index") >= rows)
        .groupBy("doc_id")
        .agg(last.alias("last"))
        .select("doc_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("__salt"), F.lit(True).alias("__long"))
    )
    return df.withColumn("__salt", F.pmod(part, F.lit(SALTS))).join(long, ["doc_id", "__salt"], "left").drop("__salt")
