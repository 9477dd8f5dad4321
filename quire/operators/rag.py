"""Retrieval documents: ``{metadataAttributes, content}`` per element or per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.images import DEFAULT_PNG, mime_or, payload_hash
from quire.functions.joins import one_per_key
from quire.functions.ordered import SEGMENT_ROWS, block_of, ordered_join
from quire.functions.text import strip, truthy_array, truthy_number, truthy_text
from quire.operators.elements import exportable, first_rows, is_image
from quire.operators.render import bracketed

# Notes added to the content of image documents.
NOTE_NOT_DESCRIBED = "[Hinweis: Bild nicht beschrieben - aktiviere 'Vision-Beschreibung' für durchsuchbaren Content]"
NOTE_UNAVAILABLE = "[Hinweis: Vision-API nicht verfügbar - Bild nicht beschrieben]"
DESCRIPTION_LABEL = "[Vision-Beschreibung]: "
INLINE_DESCRIPTION = ("[Vision-Beschreibung für ", "]: ")
INLINE_AVAILABLE = ("[Bild verfügbar - siehe separate Bild-Dateien, Hash: ", "]")
INLINE_MISSING = "[Hinweis: Kein Bild extrahiert]"
FALLBACK_DESCRIPTION = ("Bild-Element (Typ: ", ")")
FALLBACK_MODEL = "Fallback"
FALLBACK_COST = 0.0
DEFAULT_MODEL = "Unknown"
UNKNOWN_TYPE = "unknown"
# Recommended chunking per format.
CHUNK_HINTS = {"page": ("fixed_size", 512), "element": ("semantic", 300)}
CHUNK_HINT_OVERLAP = 50
PREVIEW_DOCS = 5

METADATA_KEYS = (
    "source",
    "element_index",
    "element_type",
    "page",
    "document_type",
    "parent_id",
    "hierarchy_level",
    "language",
    "has_links",
    "link_count",
    "is_table",
    "sheet_name",
    "email_subject",
    "email_from",
    "image_hash",
    "image_available",
    "image_url",
    "image_described",
    "vision_model",
    "vision_cost_estimate",
)


def check_format(format_type: str) -> str:
    if format_type not in CHUNK_HINTS:
        raise ValueError(f"format_type is 'element' or 'page', not {format_type!r}")
    return format_type


def chunk_hint(elements: DataFrame, format_type: str = "element") -> DataFrame:
    """Per document, the number of rows and the recommended chunking of the format."""
    strategy, size = CHUNK_HINTS[check_format(format_type)]
    return elements.groupBy("doc_id").agg(F.count("*").alias("elements")).select(
        "doc_id",
        "elements",
        F.lit(format_type).alias("format_type"),
        F.lit(strategy).alias("strategy"),
        F.lit(size).alias("chunk_size"),
        F.lit(CHUNK_HINT_OVERLAP).alias("overlap"),
    )


def _note(text: Column, note: Column | str) -> Column:
    return F.concat(text, F.lit("\n\n"), F.lit(note) if isinstance(note, str) else note)


def rag_rows(elements: DataFrame, *more: Column) -> DataFrame:
    """One row per exportable element: the metadata keys and ``content``, undescribed.  Narrow."""
    return exportable(elements).select("doc_id", *[c.alias(k) for k, c in rag_columns(elements).items()], *more)


def rag_columns(elements: DataFrame) -> dict[str, Column]:
    """The metadata keys and ``content`` of an element, undescribed."""
    text = strip(F.col("text"))
    digest = F.when(is_image(), payload_hash(elements))
    pictured = digest.isNotNull()
    links = F.size(truthy_array(F.col("links")))
    link_count = F.when(links > 0, links)
    return {
        "source": F.coalesce(truthy_text(F.col("filename")), F.col("source")),
        "element_index": F.col("element_index"),
        "element_type": F.col("element_type"),
        "page": truthy_number(F.col("page_number")),
        "document_type": truthy_text(F.col("filetype")),
        "parent_id": truthy_text(F.col("parent_id")),
        "hierarchy_level": F.col("category_depth"),
        "language": F.get(F.col("languages"), F.lit(0)),
        "has_links": F.when(link_count.isNotNull(), True),
        "link_count": link_count,
        "is_table": F.when(F.length("text_as_html") > 0, True),
        "sheet_name": truthy_text(F.col("page_name")),
        "email_subject": truthy_text(F.col("subject")),
        "email_from": truthy_text(F.col("sent_from")),
        "image_hash": digest,
        "image_available": F.when(pictured, True),
        "image_url": F.when(pictured, truthy_text(F.col("url"))),
        "image_described": F.when(is_image(), False),
        "vision_model": F.lit(None).cast("string"),
        "vision_cost_estimate": F.lit(None).cast("double"),
        "content": text,
    }


def rag_line(elements: DataFrame) -> Column:
    """The JSON line of an exportable element itself, with the note on pictures."""
    columns = rag_columns(elements)
    content = F.when(is_image(), _note(columns["content"], NOTE_NOT_DESCRIBED)).otherwise(columns["content"])
    meta = F.struct(*[columns[k].alias(k) for k in METADATA_KEYS])
    return F.to_json(F.struct(meta.alias("metadataAttributes"), content.alias("content")))


def with_hints(rows: DataFrame) -> DataFrame:
    """Content of image rows gets the note that the picture was not described."""
    return rows.withColumn(
        "content", F.when(is_image(), _note(F.col("content"), NOTE_NOT_DESCRIBED)).otherwise(F.col("content"))
    )


def describe(rows: DataFrame, descriptions: DataFrame, fallback: bool = False) -> DataFrame:
    """Add descriptions ``(image_hash, description, model, cost_estimate)`` to hashed rows.

    A picture that recurs everywhere makes one hot key, which adaptive execution splits
    on the row side of this outer join.  Descriptions are made unique per hash first, so
    the join cannot multiply rows.  With ``fallback`` a picture without a description is
    described by its ``mime_type``; otherwise its content notes that there is none.
    """
    described_by = F.min(F.struct("description", "model", "cost_estimate")).alias("d")
    unique = one_per_key(descriptions, ["image_hash"], described_by)
    joined = rows.join(unique, "image_hash", "left")
    text = F.col("content")
    given = truthy_text(F.col("d.description"))
    description = given
    if fallback:
        before, after = FALLBACK_DESCRIPTION
        description = F.coalesce(given, F.concat(F.lit(before), "mime_type", F.lit(after)))
    described = F.coalesce(description != text, F.lit(False))
    content = (
        F.when(described, F.concat(text, F.lit("\n\n" + DESCRIPTION_LABEL), description))
        .when(description.isNull(), _note(text, NOTE_UNAVAILABLE))
        .otherwise(text)
    )
    # What the table does not say stays NULL.
    model = F.when(given.isNull(), FALLBACK_MODEL).otherwise(F.col("d.model"))
    cost = F.when(given.isNull(), FALLBACK_COST).otherwise(F.col("d.cost_estimate"))
    return joined.select(
        "doc_id",
        *[c for c in METADATA_KEYS if not c.startswith(("image_described", "vision_"))],
        described.alias("image_described"),
        F.when(described, model).alias("vision_model"),
        F.when(described, cost).alias("vision_cost_estimate"),
        content.alias("content"),
    )


def rag_documents(
    elements: DataFrame, descriptions: DataFrame | None = None, fallback: bool = False
) -> DataFrame:
    """Documents of all exportable elements, with picture descriptions where given.

    Only pictures meet the descriptions; all other rows, which have no hash to join on,
    pass by the join and are not shuffled.
    """
    if descriptions is None:
        return with_hints(rag_rows(elements))
    pictured = is_image() & payload_hash(elements).isNotNull()
    mime = mime_or(F.col("image_mime_type"), DEFAULT_PNG).alias("mime_type")
    described = describe(rag_rows(elements.filter(pictured), mime), descriptions, fallback)
    return described.unionByName(rag_rows(elements.filter(~F.coalesce(pictured, F.lit(False)))))


def rag_json() -> Column:
    """The JSON object of a row; absent keys are left out."""
    return F.to_json(F.struct(F.struct(*METADATA_KEYS).alias("metadataAttributes"), "content"))


def rag_jsonl(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "element_index", rag_json().alias("line"))


def json_arrays(lines: DataFrame, line: str, rows: int = SEGMENT_ROWS) -> DataFrame:
    """``(doc_id, segment, documents, json)``: the JSON objects of each document as an array.

    The first segment of a document opens the array and the last one closes it, so the
    segments in order, joined by commas, are one array.  Where it begins and ends comes
    from a second pass over the positions alone.
    """
    segment = block_of("element_index", rows)
    ends = lines.groupBy("doc_id").agg(F.min(segment).alias("first"), F.max(segment).alias("last"))
    edges = F.array(
        F.struct(F.col("first").alias("segment"), F.lit(True).alias("opens"), F.lit(False).alias("closes")),
        F.struct(F.col("last").alias("segment"), F.lit(False).alias("opens"), F.lit(True).alias("closes")),
    )
    parts = lines.select("doc_id", segment.alias("segment"), "element_index", F.col(line).alias("json"))
    return (
        parts.unionByName(ends.select("doc_id", F.inline(edges)), allowMissingColumns=True)
        .groupBy("doc_id", "segment")
        .agg(
            ordered_join(F.col("element_index"), F.col("json"), ",").alias("json"),
            F.count("json").alias("documents"),
            F.bool_or("opens").alias("opens"),
            F.bool_or("closes").alias("closes"),
        )
        .select("doc_id", "segment", "documents", bracketed(F.col("json"), F.col("opens"), F.col("closes")).alias("json"))
    )


def rag_json_array(documents: DataFrame, rows: int = SEGMENT_ROWS) -> DataFrame:
    return json_arrays(rag_jsonl(documents), "line", rows)


def rag_preview(documents: DataFrame, n: int = PREVIEW_DOCS) -> DataFrame:
    """The first ``n`` documents as JSON; only those are serialised."""
    return first_rows(documents, n).select("doc_id", "element_index", rag_json().alias("line"), "is_preview")


def rag_pages(elements: DataFrame, rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per page and segment; ``page_order`` is its first position.

    Rows without a page number all count as page 1, so a page can be as large as its
    document.  The contents of its segments in order, joined by blank lines, are the
    page's; the counts of its segments add up.
    """
    kept = exportable(elements).select(
        "doc_id",
        F.coalesce(truthy_number(F.col("page_number")), F.lit(1)).alias("page"),
        block_of("element_index", rows).alias("segment"),
        "element_index",
        "element_type",
        strip(F.col("text")).alias("t"),
        F.struct(
            F.coalesce(truthy_text(F.col("filename")), F.col("source")).alias("source"),
            F.coalesce(truthy_text(F.col("filetype")), F.lit(UNKNOWN_TYPE)).alias("document_type"),
            F.get("languages", F.lit(0)).alias("language"),
        ).alias("m"),
    )
    segments = kept.groupBy("doc_id", "page", "segment").agg(
        ordered_join(F.col("element_index"), F.col("t"), "\n\n").alias("content"),
        F.min("element_index").alias("page_order"),
        F.min_by("m", "element_index").alias("m"),
        F.count("*").alias("element_count"),
        F.collect_set("element_type").alias("element_types"),
    )
    return segments.select(
        "doc_id",
        "page",
        "segment",
        "page_order",
        "m.source",
        "m.document_type",
        "element_count",
        F.sort_array("element_types").alias("element_types"),
        "m.language",
        "content",
    )


def page_json() -> Column:
    meta = F.struct("source", "page", "document_type", "element_count", "element_types", "language")
    return F.to_json(F.struct(meta.alias("metadataAttributes"), "content"))


def image_stats(documents: DataFrame) -> DataFrame:
    """Described and failed images and the summed cost per document; all images are counted."""
    described = F.coalesce("image_described", F.lit(False))
    return documents.groupBy("doc_id").agg(
        F.count_if(is_image()).alias("total_images"),
        F.count_if(described).alias("images_described"),
        F.count_if(is_image() & ~described).alias("images_failed"),
        F.coalesce(F.sum(F.when(described, F.col("vision_cost_estimate"))), F.lit(0.0)).alias("total_cost_estimate"),
    )


def vision_models(documents: DataFrame) -> DataFrame:
    return (
        documents.filter(F.col("image_described"))
        .groupBy("doc_id", F.coalesce("vision_model", F.lit(DEFAULT_MODEL)).alias("model"))
        .agg(F.count("*").alias("count"))
    )


def image_references(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Image documents with the first manifest file of the same document and hash.

    The manifest side is one row per key after partial aggregation; copies of a picture
    only crowd the other side, which adaptive execution splits.
    """
    files = manifest.select("doc_id", F.col("hash").alias("image_hash"), "filename", "element_index")
    first = one_per_key(files, ["doc_id", "image_hash"], F.min_by("filename", "element_index").alias("filename"))
    wanted = documents.filter(F.col("image_hash").isNotNull())
    return wanted.join(first, ["doc_id", "image_hash"], "left").select(
        "doc_id", "element_index", "image_hash", "filename"
    )


def orphan_references(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Image documents whose hash is not in the manifest."""
    known = one_per_key(manifest.select("doc_id", F.col("hash").alias("image_hash")), ["doc_id", "image_hash"])
    wanted = documents.filter(F.col("image_hash").isNotNull())
    return wanted.join(known, ["doc_id", "image_hash"], "left_anti").select("doc_id", "element_index", "image_hash")


_NOT_GIVEN = "CAST(NULL AS struct<description:string,model:string,cost_estimate:double>)"


def inline_rag(elements: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """The inline export: every element, blank ones and page breaks too.

    Narrow without ``descriptions`` (image_hash, description, model, cost_estimate).  With
    them pictures are looked up by their full hash; what is not found is available only.
    """
    rows = elements.withColumn("__hash", F.when(is_image(), payload_hash(elements)))
    if descriptions is None:
        return _inline_rows(rows.withColumn("__d", F.expr(_NOT_GIVEN)))
    described_by = F.min(F.struct("description", "model", "cost_estimate")).alias("__d")
    unique = one_per_key(descriptions.withColumnRenamed("image_hash", "__hash"), ["__hash"], described_by)
    pictured = _inline_rows(rows.filter("__hash IS NOT NULL").join(unique, "__hash", "left"))
    return pictured.unionByName(inline_rag(elements.filter(F.when(is_image(), payload_hash(elements)).isNull())))


def _inline_columns(digest: Column, given: Column) -> dict[str, Column]:
    """Columns of the inline export from a payload's hash and what describes it, if anything."""
    text = strip(F.coalesce("text", F.lit("")))
    available = digest.isNotNull()
    description = truthy_text(given["description"])
    described = description.isNotNull()
    content = (
        F.when(~is_image(), text)
        .when(
            described,
            _note(text, F.concat(F.lit(INLINE_DESCRIPTION[0]), "element_type", F.lit(INLINE_DESCRIPTION[1]), description)),
        )
        .when(available, _note(text, F.concat(F.lit(INLINE_AVAILABLE[0]), digest, F.lit(INLINE_AVAILABLE[1]))))
        .otherwise(_note(text, INLINE_MISSING))
    )
    return {
        "element_id": F.col("element_index") + 1,
        "element_type": F.col("element_type"),
        "source_file": F.col("source"),
        "page": truthy_number(F.col("page_number")),
        "image_available": F.when(is_image(), available),
        "image_hash": digest,
        "image_described": F.when(is_image(), described),
        "vision_model": F.when(described, given["model"]),
        "vision_cost_estimate": F.when(described, given["cost_estimate"]),
        "content": content,
    }


def _inline_rows(rows: DataFrame) -> DataFrame:
    columns = _inline_columns(F.col("__hash"), F.col("__d"))
    return rows.select("doc_id", "element_index", *[c.alias(k) for k, c in columns.items()])


INLINE_KEYS = (
    "element_id",
    "element_type",
    "source_file",
    "page",
    "image_available",
    "image_hash",
    "image_described",
    "vision_model",
    "vision_cost_estimate",
)


def inline_json() -> Column:
    return F.to_json(F.struct(F.struct(*INLINE_KEYS).alias("metadataAttributes"), "content"))


def inline_line(elements: DataFrame) -> Column:
    """The inline JSON object of an element itself, without descriptions."""
    columns = _inline_columns(F.when(is_image(), payload_hash(elements)), F.expr(_NOT_GIVEN))
    meta = F.struct(*[columns[k].alias(k) for k in INLINE_KEYS])
    return F.to_json(F.struct(meta.alias("metadataAttributes"), columns["content"].alias("content")))


def inline_rag_stats(rows: DataFrame) -> DataFrame:
    available = F.coalesce("image_available", F.lit(False))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("elements"),
        F.count_if(available).alias("images_available"),
        F.count_if(available & F.col("image_described")).alias("images_described"),
    )
