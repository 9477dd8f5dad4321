"""Samples of bounded size that no task and no driver has to sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_SEED = 41
#: How far below the bound the expected size stays.
_MARGIN = 0.95


def hashed_sample(rows: DataFrame, max_rows: int, *keys: Column | str) -> DataFrame:
    """All rows if they are at most ``max_rows``, else those whose keys hash below a share.

    The share follows from the number of rows, so about 0.95 ``max_rows`` are expected; the
    same rows are taken in every run.  A limit holds the bound if keys repeat a lot.
    """
    n = rows.count()
    if n <= max_rows:
        return rows
    share = int(_MARGIN * max_rows / n * (1 << 31))
    kept = rows.filter(F.shiftrightunsigned(F.xxhash64(*keys, F.lit(_SEED)), 33) < share)
    return kept.limit(max_rows)
