"""Cleaning, contact extraction and table export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import (
    EMAIL,
    IPV4,
    URL,
    US_PHONE,
    clean_whitespace,
    join_broken_paragraphs,
    present,
    strip,
    table_csv,
    truthy_text,
)

CONTEXT_CHARS = 100
# Kind, pattern, and a condition that every text with a match meets: a phone number of
# any notation begins with the three digits of an area code.
CONTACTS = (
    ("email", EMAIL, lambda text: F.contains(text, F.lit("@"))),
    ("phone", US_PHONE, lambda text: text.rlike("[2-9][0-9]{2}")),
    ("ip", IPV4, lambda text: F.contains(text, F.lit("."))),
    ("url", URL, lambda text: F.contains(text, F.lit("http"))),
)


def clean_text(elements: DataFrame, group_paragraphs: bool = False) -> DataFrame:
    """White space cleaned in every text that is not blank; blank rows are kept as they are."""
    cleaned = clean_whitespace(strip(F.col("text")))
    if group_paragraphs:
        cleaned = join_broken_paragraphs(cleaned)
    return elements.withColumn("text", F.when(present(F.col("text")), cleaned).otherwise(F.col("text")))


def group_paragraphs(elements: DataFrame) -> DataFrame:
    return elements.withColumn("text", join_broken_paragraphs(F.col("text")))


def clean_counts(elements: DataFrame) -> DataFrame:
    """Rows before and after cleaning, and how many texts cleaning changed."""
    cleaned = clean_text(elements.withColumn("__raw", F.col("text")))
    return cleaned.groupBy("doc_id").agg(
        F.count("*").alias("original_count"),
        F.count("*").alias("cleaned_count"),
        F.count_if(F.col("text") != F.col("__raw")).alias("changed_count"),
    )


def contacts(elements: DataFrame, kinds: tuple[str, ...] = ("email", "phone", "ip", "url")) -> DataFrame:
    """All matches of the asked kinds, one row each, from a single pass over the text."""
    text = F.col("__text")

    def found(kind: str, pattern: str, needed: Callable[[Column], Column]) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        rows = F.transform(hits, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
        return F.when(needed(text), rows).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))

    lists = [found(*c) for c in CONTACTS if c[0] in kinds]
    return (
        elements.select("doc_id", "element_index", "element_type", strip(F.col("text")).alias("__text"))
        .select("doc_id", "element_index", "element_type", F.substring("__text", 1, CONTEXT_CHARS).alias("context"), F.explode(F.concat(*lists)).alias("c"))
        .select("doc_id", "element_index", "element_type", "c.kind", "c.value", "context")
    )


def contact_totals(elements: DataFrame) -> DataFrame:
    """Matches per kind and document; documents without any keep a row of zeros."""
    text = strip(F.col("text"))
    counts = {
        kind: F.when(needed(text), F.regexp_count(text, F.lit(pattern))).otherwise(0)
        for kind, pattern, needed in CONTACTS
    }
    names = {"email": "total_emails", "phone": "total_phones", "ip": "total_ips", "url": "total_urls"}
    return elements.groupBy("doc_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(names[kind]) for kind, c in counts.items()]
    )


def table_exports(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("element_type") == "Table").select(
        "doc_id",
        "element_index",
        strip(F.col("text")).alias("text"),
        truthy_text(F.col("text_as_html")).alias("html"),
        table_csv(F.col("text")).alias("csv"),
    )
