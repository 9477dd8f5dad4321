"""Elements, quarantine and counts from one pass over the raw rows.

Every raw row becomes its elements or, if it has none, one row with the reason.  Both are
one stream, written into two folders by one job, and counted as it is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from quire.schema import ELEMENT_COLUMNS, conform, element_schema
from quire.sources.documents import partition_html, partition_text

BODIES = ("text", "html", "json")
_EXTRA = "reason string, raw_body string"


def intake_rows(raw: DataFrame, body: str) -> DataFrame:
    """Canonical element columns, ``kind`` (element or quarantine), ``reason``, ``raw_body``.

    ``raw`` has doc_id, source and the column ``body``: ``text``, ``html`` or ``json``.  The
    raw body is kept only where it gives no elements.  Narrow.
    """
    if body not in BODIES:
        raise ValueError(f"a body is one of {', '.join(BODIES)}, not {body!r}")
    kept = raw.select("doc_id", "source", F.col(body), F.col(body).alias("__raw"))
    missing = F.when(F.col("__raw").isNull(), f"no {body}")
    if body == "json":
        e = F.from_json(body, element_schema())
        parsed = kept.withColumn("e", e)
        reason = missing.when(F.col("e.doc_id").isNull(), "not an element with a document number")
        columns = [
            F.when(reason.isNotNull(), F.col(c)).otherwise(F.col(f"e.{c}")).alias(c) if c in ("doc_id", "source") else F.col(f"e.{c}").alias(c)
            for c in ELEMENT_COLUMNS
        ]
        found = parsed.select(*columns, "__raw", reason.alias("reason"))
    else:
        made = partition_text(kept, outer=True) if body == "text" else partition_html(kept, outer=True)
        reason = F.when(F.col("element_index").isNull(), missing.otherwise("nothing visible"))
        found = conform(made).withColumn("reason", reason)
    bad = F.col("reason").isNotNull()
    return found.select(
        *ELEMENT_COLUMNS, "reason", F.when(bad, F.col("__raw")).alias("raw_body"), F.when(bad, "quarantine").otherwise("element").alias("kind")
    )


@dataclass(frozen=True)
class Intake:
    elements: DataFrame
    quarantine: DataFrame


def _counts() -> list[Column]:
    kind = F.col("kind")
    empty = (F.col("text").isNull()) | (F.col("text") == "")
    return [
        F.count_if(kind == "element").alias("elements"),
        F.count_if(kind == "quarantine").alias("quarantined"),
        F.count_if((kind == "element") & empty).alias("without_text"),
        F.count_if(F.col("element_type") == "Table").alias("tables"),
        F.count_if(F.col("element_type") == "Image").alias("images"),
    ]


def write_intake(raw: DataFrame, body: str, path: str) -> dict[str, int]:
    """Write elements and quarantine below ``path`` in one job; returns the counts taken on the way.

    The folder counts as written when Spark's ``_SUCCESS`` is there; writing again replaces it.
    """
    seen = Observation(f"intake of {body}")
    rows = intake_rows(raw, body).observe(seen, *_counts())
    rows.write.mode("overwrite").partitionBy("kind").parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}


def read_intake(spark: SparkSession, path: str) -> Intake:
    columns = ", ".join(f"`{k}` {v}" for k, v in ELEMENT_COLUMNS.items())
    rows = spark.read.schema(f"{columns}, {_EXTRA}, kind string").parquet(path)
    elements = rows.filter(F.col("kind") == "element").select(*ELEMENT_COLUMNS)
    bad = rows.filter(F.col("kind") == "quarantine").select("doc_id", "source", "raw_body", "reason")
    return Intake(elements, bad)
