"""Column expressions over base64 image payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import truthy_text

DEFAULT_JPEG = "image/jpeg"
DEFAULT_PNG = "image/png"

# How much of a payload the prefix hash reads, and the digits a full hash keeps.
HASH_PREFIX_CHARS = 1000
FULL_HASH_DIGITS = 16
# Names under which a written table may hold the hashes.
HASH_COLUMNS = {"prefix": "payload_hash_prefix", "full": "payload_hash_full"}


def encode_base64(col: Column) -> Column:
    """Base64 without the line breaks that Spark puts after every 76 characters."""
    return F.translate(F.base64(col), "\r\n", "")


def decode_base64(col: Column) -> Column:
    """The bytes, or NULL for a payload that is not base64."""
    return F.try_to_binary(col, F.lit("base64"))


def image_hash(payload: Column, scope: str = "full") -> Column:
    """``full``: 16 digits of the md5 of all of it; ``prefix``: md5 of the first 1000 characters.

    Only the full hash tells pictures apart: a common header fills the prefix.
    """
    if scope == "prefix":
        return F.md5(F.substring(payload, 1, HASH_PREFIX_CHARS).cast("binary"))
    if scope == "full":
        return F.substring(F.md5(payload.cast("binary")), 1, FULL_HASH_DIGITS)
    raise ValueError(f"hash scope is 'prefix' or 'full', not {scope!r}")


def payload_hash(df: DataFrame, scope: str = "full") -> Column:
    """The hash of a row's payload, NULL without one.

    A table that was written with the hash as a column of its own (see
    :func:`with_image_hashes`) is read without its payloads.
    """
    name = HASH_COLUMNS[scope]
    return F.col(name) if name in df.columns else image_hash(truthy_text(F.col("image_base64")), scope)


def with_image_hashes(df: DataFrame) -> DataFrame:
    """Both hashes as columns, to be written next to the payload once."""
    return df.select("*", *[payload_hash(df, scope).alias(name) for scope, name in HASH_COLUMNS.items() if name not in df.columns])


def mime_or(col: Column, default: str) -> Column:
    return F.coalesce(truthy_text(col), F.lit(default))


def image_extension(mime: Column) -> Column:
    """File extension from a MIME type, png where nothing else fits."""
    mime = mime_or(mime, DEFAULT_PNG)
    return (
        F.when(mime.contains("jpeg") | mime.contains("jpg"), "jpg")
        .when(mime.contains("gif"), "gif")
        .when(mime.contains("webp"), "webp")
        .otherwise("png")
    )


def mime_subtype(mime: Column) -> Column:
    return F.substring_index(mime_or(mime, DEFAULT_PNG), "/", -1)


def image_file_name(page: Column, digest: Column, extension: Column, packaged: bool = False) -> Column:
    pattern = "images/page_%03d_%s.%s" if packaged else "page_%03d_hash_%s.%s"
    return F.format_string(pattern, page, digest, extension)


def data_url(mime: Column, payload: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), payload)


def redact_data_urls(markdown: Column) -> Column:
    """Inline image data replaced by a short note that keeps the alt text."""
    # The pattern and its replacement.
    return F.regexp_replace(markdown, r"!\[([^\]]*)\]\(data:image/[^)]+\)", "🖼️ [Bild: $1]")
