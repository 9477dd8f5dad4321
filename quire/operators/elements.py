"""Filters, projections and counts over the element table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.images import DEFAULT_JPEG, mime_or
from quire.functions.ordered import SEGMENT_ROWS, block_of, running_sum
from quire.functions.text import (
    present,
    sentence_marks,
    strip,
    truthy_array,
    truthy_number,
    truthy_text,
    word_count,
)
from quire.schema import ANALYSIS_IMAGE_TYPES, IMAGE_TYPES, PAGE_BREAK, SPECIAL_TYPES

KEY = ("doc_id", "element_index")
PREVIEW_CHARS = 100
DETAIL_CHARS = 200


def is_image() -> Column:
    return F.col("element_type").isin(*IMAGE_TYPES)


def has_payload() -> Column:
    return F.length("image_base64") > 0


def preview(chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(strip(F.coalesce("text", F.lit(""))), 1, chars)


def nonempty(elements: DataFrame) -> DataFrame:
    return elements.filter(present(F.col("text")))


def exportable(elements: DataFrame) -> DataFrame:
    """Rows that go into an export: text is not blank and the row is no page break."""
    return nonempty(elements).filter(F.col("element_type") != PAGE_BREAK)


def reindex(elements: DataFrame) -> DataFrame:
    """Renumber positions from 0 without gaps, in the old order.  One shuffle."""
    counted = running_sum(elements, ["doc_id"], "element_index", F.lit(1), "__rank", inclusive=False)
    return counted.withColumn("element_index", F.col("__rank").cast("int")).drop("__rank")


def first_elements(elements: DataFrame, n: int = 5, chars: int = 300) -> DataFrame:
    """Preview of the first ``n`` rows of each document; blank rows are dropped after the cut.

    Rows are counted, as positions may have gaps or begin late.
    """
    text = strip(F.col("text"))
    return nonempty(first_rows(elements, n)).select(
        *KEY,
        "element_type",
        F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text).alias("preview"),
    )


def remaining_elements(elements: DataFrame, n: int = 5) -> DataFrame:
    return elements.groupBy("doc_id").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("remaining"))


def element_details(elements: DataFrame) -> DataFrame:
    return elements.select(
        *KEY,
        "element_type",
        preview(DETAIL_CHARS).alias("text_preview"),
        F.length(strip(F.coalesce("text", F.lit("")))).alias("text_length"),
        F.lit(True).alias("has_metadata"),
        truthy_number(F.col("detection_class_prob")).alias("detection_class_prob"),
    )


def details_by_type(elements: DataFrame, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Details listed per type, in segments so that a frequent type stays bounded."""
    detail = F.struct("element_index", "text_preview", "text_length", "detection_class_prob")
    return (
        element_details(elements)
        .groupBy("doc_id", "element_type", block_of("element_index", rows).alias("segment"))
        .agg(F.sort_array(F.collect_list(detail)).alias("details"), F.count("*").alias("count"))
    )


def image_gallery(elements: DataFrame) -> DataFrame:
    return elements.filter(is_image() & has_payload()).select(
        *KEY,
        "element_type",
        "image_base64",
        mime_or(F.col("image_mime_type"), DEFAULT_JPEG).alias("mime_type"),
        strip(F.col("text")).alias("caption"),
        "page_number",
    )


def analysis_class() -> Column:
    """``image``, ``table``, ``special`` or NULL, the first that fits."""
    kind = F.col("element_type")
    name = F.lower(kind)
    return (
        F.when(kind.isin(*ANALYSIS_IMAGE_TYPES) | name.contains("image"), "image")
        .when(name.contains("table"), "table")
        .when(kind.isin(*SPECIAL_TYPES), "special")
    )


def analysis_images(elements: DataFrame) -> DataFrame:
    payload = truthy_text(F.col("image_base64"))
    return elements.filter(analysis_class() == "image").select(
        *KEY,
        "element_type",
        strip(F.col("text")).alias("text"),
        payload.isNotNull().alias("has_base64"),
        payload.alias("base64_data"),
        F.when(payload.isNotNull(), mime_or(F.col("image_mime_type"), DEFAULT_JPEG)).alias("mime_type"),
    )


def analysis_tables(elements: DataFrame) -> DataFrame:
    return elements.filter(analysis_class() == "table").select(
        *KEY, strip(F.col("text")).alias("text"), truthy_text(F.col("text_as_html")).alias("text_as_html"), "page_name"
    )


def special_elements(elements: DataFrame) -> DataFrame:
    return element_details(elements.filter(analysis_class() == "special"))


def hierarchies(elements: DataFrame) -> DataFrame:
    parent = truthy_text(F.col("parent_id"))
    return elements.filter(parent.isNotNull() | F.col("category_depth").isNotNull()).select(
        *KEY, "element_type", parent.alias("parent_id"), "category_depth", preview().alias("text_preview")
    )


def coordinate_rows(elements: DataFrame) -> DataFrame:
    return elements.filter(truthy_text(F.col("coordinates")).isNotNull()).select(
        *KEY, "element_type", "coordinates", preview().alias("text_preview")
    )


def language_rows(elements: DataFrame) -> DataFrame:
    return elements.filter(truthy_array(F.col("languages")).isNotNull()).select(
        *KEY, "element_type", "languages", preview().alias("text_preview")
    )


def emphasis_rows(elements: DataFrame) -> DataFrame:
    contents = truthy_array(F.col("emphasized_text_contents"))
    tags = truthy_array(F.col("emphasized_text_tags"))
    return elements.filter(contents.isNotNull() | tags.isNotNull()).select(
        *KEY, "element_type", contents.alias("contents"), tags.alias("tags"), preview().alias("text_preview")
    )


def link_rows(elements: DataFrame) -> DataFrame:
    return elements.select(
        *KEY, "element_type", F.posexplode("links").alias("link_index", "link"), preview().alias("text"), "page_number"
    ).select(*KEY, "element_type", "link_index", F.col("link.url").alias("url"), "text", "page_number")


def html_links(elements: DataFrame) -> DataFrame:
    return elements.select(
        *KEY, F.posexplode("link_urls").alias("link_index", "url"), "link_texts", preview().alias("text")
    ).select(*KEY, "link_index", "url", F.get("link_texts", F.col("link_index")).alias("link_text"), "text")


def image_url_rows(elements: DataFrame) -> DataFrame:
    url = truthy_text(F.col("image_url"))
    return elements.filter(url.isNotNull()).select(*KEY, url.alias("url"))


def email_rows(elements: DataFrame) -> DataFrame:
    named = [truthy_text(F.col(c)) for c in ("sent_from", "sent_to", "subject")]
    return elements.filter(F.coalesce(*named).isNotNull()).select(
        *KEY,
        "sent_from",
        "sent_to",
        "cc_recipient",
        "bcc_recipient",
        "subject",
        "email_message_id",
        "signature",
        "attached_to_filename",
    )


def header_footer_rows(elements: DataFrame) -> DataFrame:
    kind = truthy_text(F.col("header_footer_type"))
    return elements.filter(kind.isNotNull()).select(*KEY, kind.alias("type"), preview().alias("text"))


def section_rows(elements: DataFrame) -> DataFrame:
    section = truthy_text(F.col("section"))
    return elements.filter(section.isNotNull()).select(*KEY, section.alias("section"), preview().alias("text"))


def embedded_images(elements: DataFrame) -> DataFrame:
    path, payload = truthy_text(F.col("image_path")), truthy_text(F.col("image_base64"))
    return elements.filter(path.isNotNull() | payload.isNotNull()).select(
        *KEY, path.alias("path"), payload.isNotNull().alias("has_base64"), F.col("image_mime_type").alias("mime_type")
    )


def sheet_names(elements: DataFrame) -> DataFrame:
    return elements.filter(truthy_text(F.col("page_name")).isNotNull()).select("doc_id", "page_name").distinct()


def type_counts(elements: DataFrame, only_nonempty: bool = False) -> DataFrame:
    rows = nonempty(elements) if only_nonempty else elements
    return rows.groupBy("doc_id", "element_type").agg(F.count("*").alias("count"))


def partition_summary(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id").agg(
        F.count("*").alias("element_count"),
        F.count_if(is_image()).alias("image_elements"),
        F.count_if(is_image() & has_payload()).alias("image_base64"),
    )


def text_metrics(elements: DataFrame) -> DataFrame:
    """Characters, words, sentences and mean length per document.

    Each kept text counts one more character, the blank that separates texts.
    """
    text = strip(F.col("text"))
    kept = F.when(text != "", text)
    return (
        elements.select("doc_id", kept.alias("t"))
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("total_elements"),
            F.coalesce(F.sum(F.length("t") + 1), F.lit(0)).alias("total_characters"),
            F.coalesce(F.sum(word_count(F.col("t"))), F.lit(0)).alias("total_words"),
            F.coalesce(F.sum(sentence_marks(F.col("t"))), F.lit(0)).alias("total_sentences"),
            F.coalesce(F.avg(F.length("t")), F.lit(0.0)).alias("average_element_length"),
        )
    )


def analysis_totals(elements: DataFrame) -> DataFrame:
    """Totals per document; sheets are counted as distinct names."""
    kind = analysis_class()
    return elements.groupBy("doc_id").agg(
        F.count("*").alias("total_elements"),
        F.count_if(kind == "image").alias("total_images"),
        F.count_if(kind == "table").alias("total_tables"),
        F.count_if(is_image() & has_payload()).alias("gallery_images"),
        F.count_if(F.col("element_type") == "Table").alias("exported_tables"),
        F.countDistinct(truthy_text(F.col("page_name"))).alias("total_sheets"),
    )


def first_rows(df: DataFrame, n: int, order: str = "element_index") -> DataFrame:
    """The first ``n`` rows per document and whether there are more.

    One row more than asked for is kept by a window limit, which also runs before the
    shuffle, so a document sends at most ``n + 1`` rows per task.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)))
    limited = ranked.filter(F.col("__rank") <= n + 1)
    more = F.max("__rank").over(Window.partitionBy("doc_id")) > n
    return limited.withColumn("is_preview", more).filter(F.col("__rank") <= n).drop("__rank")
