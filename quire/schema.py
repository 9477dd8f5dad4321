"""The ``elements`` table: one row per typed element of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

LINK = "struct<url:string,text:string>"

# Canonical columns, all nullable; an absent field is NULL.
ELEMENT_COLUMNS: dict[str, str] = {
    "doc_id": "bigint",
    "source": "string",
    "element_index": "int",
    "element_uid": "string",
    "element_type": "string",
    "text": "string",
    "filename": "string",
    "file_directory": "string",
    "filetype": "string",
    "last_modified": "string",
    "file_size": "bigint",
    "data_source": "string",
    "url": "string",
    "page_number": "int",
    "page_name": "string",
    "parent_id": "string",
    "category_depth": "int",
    "coordinates": "string",
    "languages": "array<string>",
    "emphasized_text_contents": "array<string>",
    "emphasized_text_tags": "array<string>",
    "detection_class_prob": "double",
    "image_base64": "string",
    "image_mime_type": "string",
    "image_path": "string",
    "image_url": "string",
    "image_width": "int",
    "image_height": "int",
    "links": f"array<{LINK}>",
    "link_urls": "array<string>",
    "link_texts": "array<string>",
    "link_start_indexes": "array<int>",
    "sent_from": "string",
    "sent_to": "string",
    "cc_recipient": "string",
    "bcc_recipient": "string",
    "subject": "string",
    "email_message_id": "string",
    "signature": "string",
    "attached_to_filename": "string",
    "header_footer_type": "string",
    "section": "string",
    "text_as_html": "string",
    "is_continuation": "boolean",
    "regex_metadata": "map<string,string>",
}

# Element types that carry a picture.
IMAGE_TYPES = ("Image", "Figure", "Picture", "FigureCaption")
# Types gathered as images by the analysis (Picture is not one of them).
ANALYSIS_IMAGE_TYPES = ("Image", "FigureCaption", "Figure")
# Types gathered as special elements by the analysis.
SPECIAL_TYPES = ("Title", "ListItem", "Header", "Footer", "NarrativeText")
PAGE_BREAK = "PageBreak"


def element_schema() -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in ELEMENT_COLUMNS.items()))


def conform(df: DataFrame) -> DataFrame:
    """Add the canonical columns that ``df`` lacks as typed NULLs and order them.

    Columns outside the canonical list are kept at the end.  Catalyst prunes whatever
    a downstream operator does not read, so conforming costs nothing at scan time.
    """
    have = set(df.columns)
    cols = [
        f"CAST({f'`{name}`' if name in have else 'NULL'} AS {kind}) AS `{name}`"
        for name, kind in ELEMENT_COLUMNS.items()
    ]
    return df.selectExpr(*cols, *[f"`{c}`" for c in df.columns if c not in ELEMENT_COLUMNS])
