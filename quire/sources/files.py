"""File listings: the catalog, the accepted types and the routing by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.joins import one_per_key

# Accepted file types.
ACCEPTED_TYPES = ("pdf", "docx", "pptx", "xlsx", "jpg", "jpeg", "png", "txt", "html")
# Partitioning strategies.
STRATEGIES = ("auto", "fast", "hi_res", "ocr_only")
# Extensions per family, the method label of its own parser, and whether that
# parser yields pictures (None: not stated; "hook": as the picture hook is registered).
ROUTES = (
    ("pdf", ("pdf",), "open_source_pdf_optimized_no_forms", True),
    ("image", ("jpg", "jpeg", "png", "bmp", "tiff", "webp"), "open_source_image_optimized_no_forms", None),
    ("docx", ("docx",), "open_source_docx_with_images", True),
    ("pptx", ("pptx", "ppt"), "open_source_pptx_with_picture_partitioner_{hook}", "hook"),
    ("xlsx", ("xlsx", "xls"), "open_source_xlsx_no_image_support", False),
)
GENERIC_METHOD = "open_source_local"
GENERIC_IMAGE_FAMILIES = ("pdf", "pptx", "image")


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, length, modificationTime)`` of the files below ``path``; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "modificationTime")


def extension_of(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))


def existing_files(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Catalog entries ``(label, filename)`` whose file exists, the size in the label.

    A path that is listed several times is one file, of its greatest length.
    """
    size = F.format_number(F.col("length"), 0)
    known = one_per_key(files.select(F.col("path").alias("filename"), "length"), ["filename"], F.max("length").alias("length"))
    return catalog.join(known, "filename").select(
        F.concat("label", F.lit(" ("), size, F.lit(" bytes)")).alias("label"),
        F.col("filename").alias("path"),
        "length",
    )


def accepted_files(files: DataFrame) -> DataFrame:
    return files.filter(extension_of(F.col("path")).isin(*ACCEPTED_TYPES))


def check_strategy(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}, not {strategy!r}")
    return strategy


def route_files(
    files: DataFrame,
    strategy: str = "auto",
    picture_hook: bool = True,
    specific_failed: Column | None = None,
) -> DataFrame:
    """Add ``method``, ``image_support`` and ``strategy`` from the file extension.

    ``specific_failed`` marks files whose own parser failed; these go to the generic one.
    """
    check_strategy(strategy)
    ext = extension_of(F.col("path"))
    failed = F.lit(False) if specific_failed is None else F.coalesce(specific_failed, F.lit(False))
    family = F.lit(None).cast("string")
    method, support = F.lit(GENERIC_METHOD), F.lit(False)
    for name, extensions, label, images in reversed(ROUTES):
        here = ext.isin(*extensions)
        family = F.when(here, name).otherwise(family)
        method = F.when(here, label.format(hook=picture_hook)).otherwise(method)
        own = picture_hook if images == "hook" else images
        support = F.when(here, F.lit(own).cast("boolean")).otherwise(support)
    generic = F.coalesce(family.isin(*GENERIC_IMAGE_FAMILIES), F.lit(False))
    is_image = F.coalesce(family == "image", F.lit(False))
    return files.select(
        *files.columns,
        F.when(failed, GENERIC_METHOD).otherwise(method).alias("method"),
        F.when(failed, generic).otherwise(support).alias("image_support"),
        F.when(is_image, "hi_res").otherwise(strategy).alias("strategy"),
    )
