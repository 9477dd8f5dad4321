"""Pictures of presentations as elements and as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.images import DEFAULT_JPEG, encode_base64
from quire.functions.text import truthy_text

# Default alt texts, labels and the shape type of a group.
PICTURE_ALT = "PowerPoint-Bild"
SLIDE_PICTURE_ALT = "Bild auf Slide "
GROUPED_PICTURE_ALT = "Gruppiertes Bild auf Slide "
PICTURE_LABEL = "Picture"
GROUPED_PICTURE_LABEL = "Picture (Grouped)"
GROUP_SHAPE = 6


def picture_mime(content_type: Column, ext: Column) -> Column:
    ext = F.lower(ext)
    return F.coalesce(
        truthy_text(content_type),
        F.when(ext == "png", "image/png").when(ext == "gif", "image/gif"),
        F.lit(DEFAULT_JPEG),
    )


def picture_elements(pictures: DataFrame) -> DataFrame:
    """Image elements from ``(doc_id, element_index, page_number, name, blob, content_type, ext)``."""
    return pictures.filter(F.length("blob") > 0).select(
        "doc_id",
        "element_index",
        F.lit("Image").alias("element_type"),
        F.coalesce(truthy_text(F.col("name")), F.lit(PICTURE_ALT)).alias("text"),
        F.coalesce("page_number", F.lit(1)).alias("page_number"),
        encode_base64(F.col("blob")).alias("image_base64"),
        picture_mime(F.col("content_type"), F.col("ext")).alias("image_mime_type"),
    )


def slide_pictures(slides: DataFrame) -> DataFrame:
    """Pictures on slides and one level inside groups, in one pass over the shapes.

    A shape gives its own picture, or, when it is a group without one, those of its
    children; both lists are joined before a single explode.
    """

    def row(label: str, alt: str, shape: Column, child: Column | None = None) -> Column:
        x = shape if child is None else child
        return F.struct(
            F.lit(label).alias("type"),
            shape["shape_index"].alias("shape_index"),
            (F.lit(None).cast("int") if child is None else child["shape_index"]).alias("child_index"),
            x["image_base64"].alias("base64"),
            x["content_type"].alias("mime_type"),
            F.coalesce(truthy_text(x["name"]), F.concat(F.lit(alt), F.col("slide"))).alias("alt_text"),
            x["width"].alias("width"),
            x["height"].alias("height"),
        )

    own = F.transform(
        F.filter("shapes", lambda s: s["image_base64"].isNotNull()),
        lambda s: row(PICTURE_LABEL, SLIDE_PICTURE_ALT, s),
    )
    groups = F.filter("shapes", lambda s: s["image_base64"].isNull() & (s["shape_type"] == GROUP_SHAPE))
    grouped = F.flatten(
        F.transform(
            groups,
            lambda s: F.transform(
                F.filter(s["children"], lambda c: c["image_base64"].isNotNull()),
                lambda c: row(GROUPED_PICTURE_LABEL, GROUPED_PICTURE_ALT, s, c),
            ),
        )
    )
    return slides.select("doc_id", "slide", F.explode(F.concat(own, grouped)).alias("p")).select(
        "doc_id", "slide", "p.*"
    )
