"""Exact duplicates: groups of equal normalised texts.

Rows are grouped by a 128-bit hash of the normalised text, which leaves most of them
alone in their group and done.  Only rows of larger groups are grouped once more, by
hash and text together; that compares their bytes, so texts that merely share a hash
fall apart.  Both groupings are aggregates with partial results on the map side, and
the joins back to the rows can be split at a hot key, so one group may be any part of
all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.joins import one_per_key
from quire.llm.stage import stage

#: ASCII white space that equality overlooks.
_BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _BLANKS, "")


def md5_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, content_hash: Callable[[Column], Column] = md5_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the row of the group with the most code points, then the smallest doc_id.
    Null texts and texts of white space alone are equal to the empty text.  A row
    without doc_id loses to one that has an id; a group without any id has no keep_id
    and keeps all its rows, as they cannot be told apart.  Rows that repeat an id are
    kept or dropped together.  Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("points"), normalised(text).alias("norm"))
    rows = rows.withColumn("hash", content_hash(F.col("norm")))
    # Read twice below; counted once.
    sizes = stage(one_per_key(rows, ["hash"], F.count(F.lit(1)).alias("group_size")), "sizes")
    alone = (
        rows.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
        .join(sizes.filter("group_size = 1"), "hash")
        .select("doc_id", F.col("doc_id").alias("keep_id"), "group_size", "text_sha256")
    )
    repeated = sizes.filter("group_size > 1").select("hash")
    several = stage(rows.join(repeated, "hash"), "repeated")
    key = ["hash", "norm"]
    # Two steps of plain numbers, as the largest of structs is found by sorting all rows.
    most = F.max(F.when(F.col("doc_id").isNotNull(), F.col("points")))
    longest = one_per_key(several, key, most.alias("most"), F.count(F.lit(1)).alias("group_size"))
    candidates = several.join(longest, key).filter("points = most OR most IS NULL")
    keepers = one_per_key(candidates, key, F.min("doc_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    grouped = several.join(keepers, key).select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns."""
    gone = exact_duplicates(docs).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
