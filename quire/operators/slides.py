"""Slide layout and footer summaries, and slides rendered to HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.images import DEFAULT_PNG, data_url, mime_or
from quire.functions.markup import escape_attribute, escape_html, fill
from quire.functions.ordered import IMAGE_SEGMENT_ROWS, block_of, ordered_join
from quire.functions.text import strip, truthy_text
from quire.schema import IMAGE_TYPES

# What counts as the upper area of a slide, and placeholder types.
TITLE_TOP = 1_000_000
TITLE_CHARS = 100
FOOTER, SLIDE_NUMBER, DATE = 4, 12, 13
DEFAULT_LAYOUT = "Standard"

# Templates of the slide rendering.
SLIDE_OPEN = '<div class="slide" data-slide="{slide}">'
SLIDE_HEADER_OPEN = '<div class="slide-header">'
SLIDE_NUMBER_TEXT = "<span>Slide {slide}</span>"
SLIDE_LAYOUT = '<span class="layout-badge">{layout}</span>'
SLIDE_CONTENT_OPEN = '<div class="slide-content">'
DIV_CLOSE = "</div>"
SLIDE_TITLE = '<h1 class="slide-title">{text}</h1>'
SLIDE_TEXT = '<p class="slide-text">{text}</p>'
SLIDE_LIST_ITEM = '<li class="slide-list-item">{text}</li>'
SLIDE_TABLE = '<div class="slide-table">{html}</div>'
SLIDE_IMAGE = '''
                    <div class="slide-image">
                        <img src="{url}"
                             alt="{alt}"
                             class="pptx-image"/>
                        <p class="image-caption">{text}</p>
                    </div>
                    '''
SLIDE_NO_IMAGE = '<div class="image-placeholder">🖼️ Bild: {text}</div>'
NOTES_OPEN = '<div class="slide-notes">'
NOTES_LABEL = '<div class="notes-label">📝 Notizen:</div>'
NOTES_TEXT = '<div class="notes-text">{text}</div>'
FOOTER_OPEN = '<div class="slide-footer">'
FOOTER_TEXT = '<span class="footer-text">{text}</span>'
FOOTER_DATE = '<span class="footer-text">📅 {text}</span>'
FOOTER_LINE = "<div>{parts}</div>"
FOOTER_NUMBER = '<span class="slide-number">{text}</span>'
FOOTER_SEPARATOR = " | "


def slide_layout(slides: DataFrame) -> DataFrame:
    """Shape count, title, tables and images per slide, from the slide's own shape array.

    The last shape that looks like a title gives the title text.
    """
    text = lambda s: strip(s["text"])
    titles = F.filter(
        "shapes",
        lambda s: F.coalesce(s["has_text_frame"] & (text(s) != "") & (s["top"] < TITLE_TOP), F.lit(False)),
    )
    ordered = F.sort_array(F.transform(titles, lambda s: F.struct(s["shape_index"].alias("i"), text(s).alias("t"))))
    return slides.select(
        "doc_id",
        "slide",
        "layout_name",
        F.size("shapes").alias("shape_count"),
        (F.size(titles) > 0).alias("has_title"),
        F.exists("shapes", lambda s: s["image_base64"].isNotNull()).alias("has_images"),
        F.exists("shapes", lambda s: F.coalesce(s["has_table"], F.lit(False))).alias("has_tables"),
        F.substring(F.try_element_at(ordered, F.lit(-1))["t"], 1, TITLE_CHARS).alias("title_text"),
    )


def slide_footers(slides: DataFrame) -> DataFrame:
    """Footer, slide number, date and notes per slide; the last placeholder of a kind wins."""

    def last_text(kind: int, blank: bool) -> Column:
        found = F.filter(
            "shapes",
            lambda s: F.coalesce(
                (s["placeholder_type"] == kind)
                & s["has_text_frame"]
                & (F.lit(True) if blank else strip(s["text"]) != ""),
                F.lit(False),
            ),
        )
        pairs = F.transform(
            found, lambda s: F.struct(s["shape_index"].alias("i"), strip(F.coalesce(s["text"], F.lit(""))).alias("t"))
        )
        return F.try_element_at(F.sort_array(pairs), F.lit(-1))["t"]

    return slides.select(
        "doc_id",
        "slide",
        last_text(FOOTER, False).alias("footer_text"),
        last_text(SLIDE_NUMBER, True).alias("slide_number"),
        last_text(DATE, True).alias("date_text"),
        truthy_text(strip(F.col("notes"))).alias("notes"),
    )


def slide_footer_summary(footers: DataFrame) -> DataFrame:
    return footers.groupBy("doc_id").agg(
        F.bool_or(F.col("footer_text").isNotNull()).alias("has_footer"),
        F.bool_or(F.col("slide_number").isNotNull()).alias("has_slide_numbers"),
        F.bool_or(F.col("date_text").isNotNull()).alias("has_date"),
        F.count("footer_text").alias("footer_count"),
        F.count("notes").alias("notes_count"),
    )


def first_layouts(layouts: DataFrame) -> DataFrame:
    """One layout per slide: the first by ``ord`` wins."""
    return layouts.groupBy("doc_id", "slide").agg(F.min_by("layout_name", "ord").alias("layout_name"))


def with_layout(slides: DataFrame, layouts: DataFrame) -> DataFrame:
    named = first_layouts(layouts)
    return slides.drop("layout_name").join(named, ["doc_id", "slide"], "left").withColumn(
        "layout_name", F.coalesce("layout_name", F.lit(DEFAULT_LAYOUT))
    )


FOOTER_FIELDS = ("footer_text", "slide_number", "date_text", "notes")


def first_footers(footers: DataFrame) -> DataFrame:
    """One footer row per slide: the first by ``ord``, or else the smallest by its fields."""
    fields = F.struct(*FOOTER_FIELDS)
    order = F.struct("ord", fields) if "ord" in footers.columns else fields
    return footers.groupBy("doc_id", "slide").agg(F.min_by(fields, order).alias("f")).select("doc_id", "slide", "f.*")


def with_footer(slides: DataFrame, footers: DataFrame) -> DataFrame:
    """Footer fields by slide; where ``footers`` has several rows for a slide, the first."""
    return slides.join(first_footers(footers), ["doc_id", "slide"], "left")


def slide_part() -> Column:
    """HTML of one element on its slide, NULL for types that a slide does not show."""
    kind = F.col("element_type")
    raw = F.coalesce("text", F.lit(""))
    text = escape_html(raw)
    payload = truthy_text(F.col("image_base64"))
    url = data_url(escape_attribute(mime_or(F.col("image_mime_type"), DEFAULT_PNG)), payload)
    image = F.when(
        payload.isNotNull(), fill(SLIDE_IMAGE, url=url, alt=escape_attribute(raw), text=text)
    ).otherwise(fill(SLIDE_NO_IMAGE, text=text))
    return (
        F.when(kind == "Title", fill(SLIDE_TITLE, text=text))
        .when(kind.isin("NarrativeText", "Text"), fill(SLIDE_TEXT, text=text))
        .when(kind == "ListItem", fill(SLIDE_LIST_ITEM, text=text))
        .when(kind == "Table", fill(SLIDE_TABLE, html=F.coalesce(truthy_text(F.col("text_as_html")), text)))
        .when(kind.isin(*IMAGE_TYPES), image)
    )


def _slide_frame(slides: DataFrame, layouts: DataFrame | None, footers: DataFrame | None) -> DataFrame:
    """Opening and closing HTML of each slide, from its layout and footer."""
    framed = slides
    framed = with_layout(framed, layouts) if layouts is not None else framed.withColumn("layout_name", F.lit(DEFAULT_LAYOUT))
    if footers is not None:
        framed = with_footer(framed, footers)
    else:
        for name in ("footer_text", "slide_number", "date_text", "notes"):
            framed = framed.withColumn(name, F.lit(None).cast("string"))
    line = "\n"
    head = F.concat_ws(
        line,
        fill(SLIDE_OPEN, slide=F.col("slide")),
        F.lit(SLIDE_HEADER_OPEN),
        fill(SLIDE_NUMBER_TEXT, slide=F.col("slide")),
        fill(SLIDE_LAYOUT, layout=escape_html(F.col("layout_name"))),
        F.lit(DIV_CLOSE),
        F.lit(SLIDE_CONTENT_OPEN),
    )
    footer, number, date, notes = (truthy_text(F.col(c)) for c in ("footer_text", "slide_number", "date_text", "notes"))
    notes_block = F.when(
        notes.isNotNull(),
        F.concat_ws(line, F.lit(NOTES_OPEN), F.lit(NOTES_LABEL), fill(NOTES_TEXT, text=escape_html(notes)), F.lit(DIV_CLOSE)),
    )
    parts = F.concat_ws(
        FOOTER_SEPARATOR, fill(FOOTER_TEXT, text=escape_html(footer)), fill(FOOTER_DATE, text=escape_html(date))
    )
    footer_block = F.when(
        F.coalesce(footer, number, date).isNotNull(),
        F.concat_ws(
            line,
            F.lit(FOOTER_OPEN),
            fill(FOOTER_LINE, parts=parts),
            fill(FOOTER_NUMBER, text=escape_html(number)),
            F.lit(DIV_CLOSE),
        ),
    )
    tail = F.concat_ws(line, F.lit(DIV_CLOSE), notes_block, footer_block, F.lit(DIV_CLOSE))
    return framed.select("doc_id", "slide", "last", head.alias("head"), tail.alias("tail"))


def render_slides(
    elements: DataFrame,
    layouts: DataFrame | None = None,
    footers: DataFrame | None = None,
    rows: int = IMAGE_SEGMENT_ROWS,
    style: str | None = None,
) -> DataFrame:
    """``(doc_id, slide, segment, html)``: each slide in segments of ``rows`` positions.

    All rows of a document, ordered by slide (NULL first) and segment and joined by line
    breaks, are its page.  A slide opens with segment -1 and closes with one past its
    last.  ``style`` is put before the first slide of each document, as a row without
    slide; there is none by default.  Elements without a page all land on slide 1, so a slide is bounded by segments, not
    by itself.  Frames come from one narrow row per slide and are added as parts.
    """
    placed = elements.withColumn("slide", F.coalesce("page_number", F.lit(1)))
    parts = placed.select(
        "doc_id",
        "slide",
        block_of("element_index", rows).alias("segment"),
        F.col("element_index").cast("long").alias("place"),
        slide_part().alias("html"),
    )
    extent = placed.groupBy("doc_id", "slide").agg(F.max("element_index").alias("last"))
    edges = F.array(
        F.struct(F.lit(-1).alias("segment"), F.col("head").alias("html")),
        F.struct((block_of("last", rows) + 1).alias("segment"), F.col("tail").alias("html")),
    )
    framed = _slide_frame(extent, layouts, footers).select("doc_id", "slide", F.inline(edges))
    if style:
        sheet = (F.lit(None).cast("int").alias("slide"), F.lit(-1).alias("segment"), F.lit(style).alias("html"))
        framed = framed.unionByName(elements.select("doc_id").distinct().select("doc_id", *sheet))
    body = parts.groupBy("doc_id", "slide", "segment").agg(
        F.count("html").alias("shown"), ordered_join(F.col("place"), F.col("html"), "\n").alias("html")
    )
    body = body.filter(F.col("shown") > 0)
    return body.select("doc_id", "slide", "segment", "html").unionByName(framed)
