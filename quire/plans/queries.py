"""Named queries: each runs one operator over the whole of its tables.

Nested results are flattened to scalars here so that a SQL engine can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import markup
from quire.functions.images import (
    decode_base64,
    encode_base64,
    image_extension,
    image_file_name,
    image_hash,
    mime_subtype,
)
from quire.functions.text import strip
from quire.operators import chunking, elements as el, export, images, rag, render, slides as sl, text as tx
from quire.plans import derived as d
from quire.functions.language import train_profiles
from quire.sources import documents as docs, files as fl, slides as sp
from quire.sources.hooks import apply_hook, register_hook
from quire.sources.intake import read_intake, write_intake
from quire.sources.named_files import read_named
from quire.schema import ELEMENT_COLUMNS
from quire.session import shared_dir
from quire.streaming.ingest import document_stream, ingest_available
from quire.streaming.replace import current_elements, replace_elements

Query = Callable[[SparkSession, str], DataFrame]

# Segments of this many positions, so that documents of these tables have several.
ROWS = 32
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _joined(column: str, sep: str = "|") -> Column:
    return F.array_join(column, sep).alias(column)


def _doc(*columns: Column | str) -> list:
    return ["doc_id", "element_index", *columns]


# --- sources ---------------------------------------------------------------------------


@query
def file_catalog(spark, sf):
    return fl.existing_files(d.catalog(spark, sf), d.files(spark, sf))


@query
def accepted_files(spark, sf):
    return fl.accepted_files(d.files(spark, sf))


@query
def route_files(spark, sf):
    return fl.route_files(d.files(spark, sf), specific_failed=F.col("length") % 17 == 0)


@query
def elements_flags(spark, sf):
    kept = docs.apply_flags(d.rich_elements(spark, sf), include_tables=False, include_images=False)
    return kept.select(*_doc("element_type", F.col("text_as_html").isNotNull().alias("has_html")))


@query
def partition_text(spark, sf):
    return d.text_elements(spark, sf).select(*_doc("element_uid", "element_type", "text", "page_number"))


@query
def partition_html(spark, sf):
    return d.html_elements(spark, sf).select(
        *_doc(
            "element_type",
            "text",
            "category_depth",
            _joined("link_urls"),
            _joined("link_texts"),
            _joined("emphasized_text_contents"),
            "image_url",
            "text_as_html",
        )
    )


@query
def page_numbers(spark, sf):
    return docs.number_pages(d.rich_elements(spark, sf)).select(*_doc("page_number"))


@query
def element_language(spark, sf):
    return docs.detect_languages(d.text_elements(spark, sf)).select(*_doc("language"))


@query
def element_languages(spark, sf):
    """All languages of each line, by profiles of the documents' own."""
    profiles = train_profiles(d.raw_documents(spark, sf))
    found = docs.detect_languages(d.text_elements(spark, sf), profiles=profiles)
    best = F.round(F.coalesce(F.get("language_probabilities", F.lit(0)), F.lit(0.0)), 6).alias("probability")
    return found.select(*_doc("language", _joined("languages"), best))


@query
def parent_links(spark, sf):
    return docs.fill_parents(d.sectioned_elements(spark, sf)).select(*_doc("parent_id"))


@query
def picture_elements(spark, sf):
    return sp.picture_elements(d.pictures(spark, sf))


@query
def hook_pictures(spark, sf):
    """Pictures by a user's class that yields one element or none for a row."""
    columns = ("element_index", "page_number", "name", "blob", "content_type", "ext")
    register_hook(spark, "picture_hook", d.PictureHook, columns)
    found = apply_hook(d.pictures(spark, sf), "picture_hook", columns)
    return found.select(*_doc("element_type", "text", "page_number", "image_base64", "image_mime_type", "hook_error"))


@query
def slide_pictures(spark, sf):
    return sp.slide_pictures(d.slides(spark, sf))


@query
def partition_status(spark, sf):
    return docs.partition_status(d.parses(spark, sf))


@query
def quarantine(spark, sf):
    bad = [docs.quarantine(raw, body).select("doc_id", "source", "reason") for body, raw in d.flawed(spark, sf).items()]
    return bad[0].unionByName(bad[1]).unionByName(bad[2])


@query
def intake_parts(spark, sf):
    """Elements and quarantine of each kind of body, written and counted in one pass each."""
    out = None
    for body, raw in d.flawed(spark, sf).items():
        path = shared_dir(spark, f"intake-{body}")
        counts = write_intake(raw, body, path)
        read = read_intake(spark, path)
        total = lambda name: F.lit(counts[name]).cast("long").alias("counted")  # noqa: B023, E731
        kinds = [
            read.elements.select(F.lit(body).alias("body"), "doc_id", "element_index", F.col("text").alias("content"), total("elements")),
            read.quarantine.select(F.lit(body).alias("body"), "doc_id", F.lit(None).cast("int").alias("element_index"), F.col("reason").alias("content"), total("quarantined")),
        ]
        for rows in kinds:
            out = rows if out is None else out.unionByName(rows)
    return out


@query
def json_unknown_members(spark, sf):
    """Elements with members that no field knows, read and written as JSON twice."""
    rows = d.rich_elements(spark, sf).select(d.with_unknown_members().alias("json"))
    once = docs.elements_from_json(rows, extra="extra").withColumn("json", docs.elements_to_json("extra"))
    back = docs.elements_from_json(once, extra="extra")
    return back.select(*_doc("element_type", "text", F.to_json("extra").alias("extra")))


@query
def json_roundtrip(spark, sf):
    rows = d.rich_elements(spark, sf)
    back = docs.elements_from_json(rows.select(F.to_json(F.struct("*")).alias("json")))

    def flat(name: str, kind: str) -> Column:
        if name == "image_base64":
            return F.md5(name).alias(name)
        return F.to_json(name).alias(name) if kind.startswith(("array", "map")) else F.col(name)

    return back.select(*[flat(c, kind) for c, kind in ELEMENT_COLUMNS.items()])


@query
def stream_partition(spark, sf):
    """The table may be one file or a folder of them, whatever their names."""
    return ingest_available(spark, f"{sf}/documents.parquet", "*").select(*_doc("element_type", "text", "page_number"))


@query
def stream_replace(spark, sf):
    """Uploads that replace, delete and come late, each a file of its own for the stream."""
    base = shared_dir(spark, "uploads")
    for k, upload in enumerate(d.uploads(spark, sf)):
        upload.write.parquet(f"{base}/in/upload-{k}.parquet")
        stream = document_stream(spark, f"{base}/in/*", schema=upload.schema)
        replace_elements(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return current_elements(spark, f"{base}/out").select(*_doc("element_type", "text", "page_number"))


# --- sinks and serialisation -----------------------------------------------------------


def _rag(spark, sf):
    return rag.rag_documents(d.rich_elements(spark, sf))


def _described(spark, sf):
    return rag.rag_documents(d.rich_elements(spark, sf), d.image_descriptions(spark, sf))


@query
def rag_jsonl(spark, sf):
    return rag.rag_jsonl(_rag(spark, sf))


@query
def rag_json_array(spark, sf):
    return rag.rag_json_array(_rag(spark, sf), ROWS)


@query
def rag_preview(spark, sf):
    return rag.rag_preview(_rag(spark, sf))


@query
def elements_json(spark, sf):
    return export.elements_json(d.rich_elements(spark, sf))


@query
def elements_full_json(spark, sf):
    return export.elements_full_json(d.rich_elements(spark, sf))


@query
def all_formats(spark, sf):
    return render.all_formats(d.rich_elements(spark, sf), rows=ROWS)


@query
def all_formats_images(spark, sf):
    return render.all_formats(d.rich_elements(spark, sf), with_images=True, rows=ROWS)


@query
def image_files(spark, sf):
    return images.image_files(d.rich_elements(spark, sf)).select(
        *_doc("filename", F.length("content").alias("size_bytes"), F.md5("content").alias("content_md5"))
    )


@query
def image_manifest(spark, sf):
    return images.ranked_manifest(d.rich_elements(spark, sf))


@query
def manifest_summary(spark, sf):
    return images.manifest_summary(d.rich_elements(spark, sf), "2025-01-01")


@query
def package_summary(spark, sf):
    return export.package_summary(d.rich_elements(spark, sf), "2025-01-01").select(
        "doc_id",
        "source_document",
        "export_date",
        "total_elements",
        "total_images",
        "rag_format",
        "images_included",
        "import_info.*",
    )


@query
def output_files(spark, sf):
    return export.output_files(d.rich_elements(spark, sf), tuple(export.OUTPUT_SUFFIXES))


@query
def written_files(spark, sf):
    """Every output file and picture file, written under its name, listed and read again."""
    e = d.rich_elements(spark, sf)
    path = shared_dir(spark, "files")
    export.write_files(e, path, tuple(export.OUTPUT_SUFFIXES), rows=ROWS)
    name = F.substring_index(F.col("path"), path.rpartition("/")[2] + "/", -1).alias("out_name")
    return read_named(spark, path).select(name, "length", F.sha2("content", 256).alias("sha256"))


@query
def package_readback(spark, sf):
    """The import package, written in one pass, verified and read back."""
    path = shared_dir(spark, "package")
    export.write_package(d.rich_elements(spark, sf), path, export_date="2025-01-01")
    package = export.read_package(spark, path)
    lines = package.documents.select("doc_id", "element_index", F.lit("line").alias("part"), F.md5("line").alias("digest"), F.lit(None).cast("string").alias("filename"))
    files = package.images.select("doc_id", "element_index", F.lit("image").alias("part"), F.md5("content").alias("digest"), "filename")
    return lines.unionByName(files)


@query
def elements_csv(spark, sf):
    return export.elements_csv(d.rich_elements(spark, sf))


# --- projections and filters -----------------------------------------------------------


@query
def nonempty_elements(spark, sf):
    return el.nonempty(d.rich_elements(spark, sf)).select(*_doc("element_type", "text"))


@query
def element_details(spark, sf):
    return el.element_details(d.rich_elements(spark, sf))


@query
def image_gallery(spark, sf):
    return el.image_gallery(d.rich_elements(spark, sf))


@query
def analysis_images(spark, sf):
    return el.analysis_images(d.rich_elements(spark, sf))


@query
def analysis_tables(spark, sf):
    return el.analysis_tables(d.rich_elements(spark, sf))


@query
def special_elements(spark, sf):
    return el.special_elements(d.rich_elements(spark, sf))


@query
def hierarchies(spark, sf):
    return el.hierarchies(d.rich_elements(spark, sf))


@query
def coordinates_rows(spark, sf):
    return el.coordinate_rows(d.rich_elements(spark, sf))


@query
def language_rows(spark, sf):
    rows = el.language_rows(d.rich_elements(spark, sf))
    return rows.select(*_doc("element_type", _joined("languages"), "text_preview"))


@query
def emphasis_rows(spark, sf):
    rows = el.emphasis_rows(d.rich_elements(spark, sf))
    return rows.select(*_doc("element_type", _joined("contents"), _joined("tags"), "text_preview"))


@query
def link_rows(spark, sf):
    return el.link_rows(d.rich_elements(spark, sf))


@query
def html_links(spark, sf):
    return el.html_links(d.html_elements(spark, sf))


@query
def image_url_rows(spark, sf):
    return el.image_url_rows(d.rich_elements(spark, sf))


@query
def email_rows(spark, sf):
    mail, i = F.col("sent_from").isNotNull(), F.col("doc_id")
    more = {
        "cc_recipient": F.when(mail & (i % 2 == 0), "c@example.org"),
        "bcc_recipient": F.when(mail & (i % 3 == 0), "d@example.org"),
        "email_message_id": F.when(mail, F.concat(F.lit("<"), i.cast("string"), F.lit("@example.org>"))),
        "signature": F.when(mail & (i % 4 == 0), "Best"),
        "attached_to_filename": F.when(mail & (i % 7 == 0), F.concat(F.lit("m"), i.cast("string"), F.lit(".eml"))),
        # Some have only a subject.
        "sent_from": F.when(i % 6 != 0, F.col("sent_from")),
        "sent_to": F.when(i % 6 != 0, F.col("sent_to")),
    }
    return el.email_rows(d.rich_elements(spark, sf).withColumns(more))


@query
def header_footer_rows(spark, sf):
    return el.header_footer_rows(d.rich_elements(spark, sf))


@query
def section_rows(spark, sf):
    return el.section_rows(d.rich_elements(spark, sf))


@query
def embedded_images(spark, sf):
    return el.embedded_images(d.rich_elements(spark, sf))


# --- joins and lookups -----------------------------------------------------------------


def _slide_rows(spark, sf):
    return d.slides(spark, sf).select("doc_id", "slide")


@query
def slide_layout_join(spark, sf):
    return sl.with_layout(_slide_rows(spark, sf), d.layouts(spark, sf))


@query
def slide_footer_join(spark, sf):
    return sl.with_footer(_slide_rows(spark, sf), sl.slide_footers(d.slides(spark, sf)))


@query
def rag_image_join(spark, sf):
    return rag.image_references(_rag(spark, sf), images.image_manifest(d.rich_elements(spark, sf), packaged=True))


@query
def rag_image_orphans(spark, sf):
    inline = rag.inline_rag(d.rich_elements(spark, sf))
    return rag.orphan_references(inline, images.image_manifest(d.rich_elements(spark, sf), "prefix"))


@query
def vision_enrich(spark, sf):
    return _described(spark, sf).select(
        *_doc("element_type", "image_hash", "image_described", "vision_model", "vision_cost_estimate", "content")
    )


@query
def vision_fallback(spark, sf):
    out = rag.rag_documents(d.rich_elements(spark, sf), d.image_descriptions(spark, sf), fallback=True)
    return out.filter(F.col("image_described")).select(*_doc("vision_model", "vision_cost_estimate", "content"))


# --- aggregations ----------------------------------------------------------------------


@query
def type_counts(spark, sf):
    return el.type_counts(d.rich_elements(spark, sf))


@query
def partition_summary(spark, sf):
    return el.partition_summary(d.rich_elements(spark, sf))


@query
def text_metrics(spark, sf):
    out = el.text_metrics(d.rich_elements(spark, sf))
    return out.withColumn("average_element_length", F.round("average_element_length", 6))


@query
def contact_totals(spark, sf):
    return tx.contact_totals(d.text_elements(spark, sf))


@query
def analysis_totals(spark, sf):
    return el.analysis_totals(d.rich_elements(spark, sf))


@query
def rag_pages(spark, sf):
    return rag.rag_pages(d.rich_elements(spark, sf)).select(
        "doc_id",
        "page",
        "segment",
        "page_order",
        "source",
        "document_type",
        "element_count",
        _joined("element_types"),
        "language",
        "content",
    )


@query
def image_stats(spark, sf):
    out = rag.image_stats(_described(spark, sf))
    return out.withColumn("total_cost_estimate", F.round("total_cost_estimate", 6))


@query
def vision_models(spark, sf):
    return rag.vision_models(_described(spark, sf))


@query
def inline_rag_stats(spark, sf):
    return rag.inline_rag_stats(rag.inline_rag(d.rich_elements(spark, sf), d.image_descriptions(spark, sf)))


@query
def clean_counts(spark, sf):
    return tx.clean_counts(_messy(spark, sf))


@query
def details_by_type(spark, sf):
    return el.details_by_type(d.rich_elements(spark, sf)).select(
        "doc_id",
        "element_type",
        "segment",
        "count",
        F.array_join(F.transform("details", lambda x: x["element_index"].cast("string")), ",").alias("indexes"),
    )


@query
def sheet_names(spark, sf):
    return el.sheet_names(d.rich_elements(spark, sf))


@query
def slide_layout(spark, sf):
    return sl.slide_layout(d.slides(spark, sf))


@query
def slide_footers(spark, sf):
    return sl.slide_footers(d.slides(spark, sf))


@query
def slide_footer_summary(spark, sf):
    return sl.slide_footer_summary(sl.slide_footers(d.slides(spark, sf)))


@query
def chunk_counts(spark, sf):
    return chunking.chunk_counts(d.text_elements(spark, sf))


# --- ordered operators -----------------------------------------------------------------


@query
def reindexed_elements(spark, sf):
    return el.reindex(el.exportable(d.rich_elements(spark, sf))).select(*_doc("element_uid", "element_type"))


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id",
        "chunk_index",
        "section",
        "text",
        F.array_join(
            F.transform("orig", lambda o: F.concat_ws(":", o["element_index"], o["piece"], o["n_chars"])), " "
        ).alias("orig"),
    )


@query
def chunk_basic(spark, sf):
    return _chunk_rows(chunking.chunk_elements(d.text_elements(spark, sf)))


@query
def chunk_by_title(spark, sf):
    return _chunk_rows(chunking.chunk_elements(d.sectioned_elements(spark, sf), "by_title"))


@query
def split_oversized(spark, sf):
    return chunking.split_oversized(d.text_elements(spark, sf))


@query
def element_preview(spark, sf):
    e = d.rich_elements(spark, sf)
    return el.first_elements(e).join(el.remaining_elements(e), "doc_id")


# --- contacts, text and table functions ------------------------------------------------


def _messy(spark, sf):
    """Lines with doubled blanks, no-break spaces and broken paragraphs put in."""
    noisy = F.regexp_replace("text", " (the|de|der|la) ", "\u00a0 $1  ")
    noisy = F.regexp_replace(noisy, ", ", ",\n")
    return d.rich_elements(spark, sf).withColumn("text", F.concat(F.regexp_replace(noisy, r"\. ", ".\n \n"), F.lit("\u00a0 ")))


@query
def contacts(spark, sf):
    everything = d.text_elements(spark, sf).select(*_doc("element_type", "text"))
    return tx.contacts(everything.unionByName(d.page_urls(spark, sf).withColumn("doc_id", -F.col("doc_id"))))


@query
def contact_emails(spark, sf):
    return tx.contacts(d.text_elements(spark, sf), ("email",))


@query
def contact_phones(spark, sf):
    return tx.contacts(d.text_elements(spark, sf), ("phone",))


@query
def contact_ips(spark, sf):
    return tx.contacts(d.text_elements(spark, sf), ("ip",))


@query
def contact_urls(spark, sf):
    return tx.contacts(d.page_urls(spark, sf), ("url",))


@query
def clean_text(spark, sf):
    return tx.clean_text(_messy(spark, sf)).select(*_doc("text"))


@query
def group_paragraphs(spark, sf):
    return tx.group_paragraphs(_messy(spark, sf)).select(*_doc("text"))


@query
def table_csv(spark, sf):
    return tx.table_exports(_messy(spark, sf))


# --- image functions -------------------------------------------------------------------


def _payloads(spark, sf):
    return d.rich_elements(spark, sf).filter(F.col("image_base64").isNotNull())


@query
def image_hash_prefix(spark, sf):
    return _payloads(spark, sf).select(*_doc(image_hash(F.col("image_base64"), "prefix").alias("image_hash")))


@query
def image_hash_full(spark, sf):
    return _payloads(spark, sf).select(*_doc(image_hash(F.col("image_base64"), "full").alias("image_hash")))


@query
def image_ext(spark, sf):
    mime = F.col("image_mime_type")
    return d.rich_elements(spark, sf).select(
        *_doc(image_extension(mime).alias("extension"), mime_subtype(mime).alias("subtype"))
    )


@query
def image_file_names(spark, sf):
    packed = image_file_name(F.col("page"), F.col("image_hash"), F.col("extension"), packaged=True)
    return images.image_rows(d.rich_elements(spark, sf)).select(*_doc("filename", packed.alias("packaged")))


@query
def base64_roundtrip(spark, sf):
    payload = encode_base64(F.col("text").cast("binary"))
    payload = F.when(F.col("doc_id") % 9 == 0, F.lit("@@@")).otherwise(payload)
    rows = d.text_elements(spark, sf).select(*_doc(F.col("text"), payload.alias("payload")))
    content = decode_base64(F.col("payload"))
    return rows.select(
        *_doc("payload", F.length(content).alias("size_bytes"), (content == F.col("text").cast("binary")).alias("same"))
    )


@query
def inline_image_files(spark, sf):
    return images.inline_image_files(d.rich_elements(spark, sf))


# --- markup ----------------------------------------------------------------------------


@query
def heading_levels(spark, sf):
    depth = F.col("category_depth")
    return d.rich_elements(spark, sf).select(
        *_doc(
            markup.heading_level(depth).alias("level"),
            (markup.depth_of(depth) * markup.INDENT_PIXELS).alias("indent_pixels"),
            F.repeat(F.lit("  "), markup.depth_of(depth)).alias("indent"),
        )
    )


@query
def emphasis_markup(spark, sf):
    text, phrases = strip(F.col("text")), F.col("emphasized_text_contents")
    return d.rich_elements(spark, sf).select(
        *_doc(
            markup.emphasize(text, phrases, markup.HTML_STRONG, markup.escape_html).alias("html"),
            markup.emphasize(text, phrases, markup.MD_STRONG).alias("markdown"),
        )
    )


@query
def link_markup(spark, sf):
    links, urls, texts = F.col("links"), F.col("link_urls"), F.col("link_texts")
    return d.rich_elements(spark, sf).select(
        *_doc(
            markup.link_list(
                links, urls, texts, markup.HTML_LINK, markup.LINK_SIGN, markup.escape_html, markup.escape_attribute
            ).alias("html"),
            markup.link_list(links, urls, texts, markup.MD_LINK, markup.MD_LINK_DEFAULT).alias("markdown"),
        )
    )


@query
def badges(spark, sf):
    line = markup.badges(F.col("page_number"), F.col("languages"), F.col("category_depth"))
    return d.rich_elements(spark, sf).select(*_doc(line.alias("badges")))


@query
def redact_data_urls(spark, sf):
    return render.redacted_markdown(render.render_markdown(d.rich_elements(spark, sf)))


@query
def render_sizes(spark, sf):
    out = render.render_sizes(render.render_markdown(d.rich_elements(spark, sf)))
    return out.withColumn("size_mb", F.round("size_mb", 6))


# --- retrieval documents ---------------------------------------------------------------


@query
def rag_metadata(spark, sf):
    return _rag(spark, sf).select("doc_id", *rag.METADATA_KEYS)


@query
def rag_content(spark, sf):
    plain = _rag(spark, sf).select(*_doc(F.lit(False).alias("describe"), "content"))
    described = _described(spark, sf).select(*_doc(F.lit(True).alias("describe"), "content"))
    return plain.unionByName(described)


@query
def chunk_hint(spark, sf):
    e = d.text_elements(spark, sf)
    return rag.chunk_hint(e, "element").unionByName(rag.chunk_hint(e, "page"))


@query
def inline_rag(spark, sf):
    e = d.rich_elements(spark, sf)
    plain = rag.inline_rag(e).withColumn("describe", F.lit(False))
    described = rag.inline_rag(e, d.image_descriptions(spark, sf)).withColumn("describe", F.lit(True))
    return plain.unionByName(described).withColumn("json", rag.inline_json())


# --- rendering -------------------------------------------------------------------------


@query
def render_text(spark, sf):
    return render.render_text(d.rich_elements(spark, sf), ROWS)


@query
def render_html(spark, sf):
    return render.render_html(d.rich_elements(spark, sf))


@query
def render_markdown(spark, sf):
    return render.render_markdown(d.rich_elements(spark, sf))


@query
def render_slides(spark, sf):
    e = d.rich_elements(spark, sf)
    footers = sl.slide_footers(d.slides(spark, sf))
    return sl.render_slides(e, d.layouts(spark, sf), footers)
