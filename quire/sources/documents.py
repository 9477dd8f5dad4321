"""From raw documents to elements.  Everything here is narrow unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.html import HEADINGS, bind, blocks
from quire.functions.language import Profiles, codes_of, first_code, languages_of
from quire.functions.ordered import BLOCK, block_of, last_before, running_sum
from quire.functions.text import STOP_WORDS, language_of, truthy_text
from quire.schema import ELEMENT_COLUMNS, IMAGE_TYPES, PAGE_BREAK, element_schema

LIST_ITEM_CHARS = 60
PAGE_LINES = 5
HEADING_LEVELS = 6

# The type of a block by its innermost element.
TAG_TYPES = {"p": "NarrativeText", "li": "ListItem", "header": "Header", "footer": "Footer", "table": "Table", "img": "Image"}
DEFAULT_TYPE = "Text"


def line_type(text: Column, position: Column) -> Column:
    return (
        F.when(text == "", PAGE_BREAK)
        .when(position == 0, "Title")
        .when(F.length(text) <= LIST_ITEM_CHARS, "ListItem")
        .otherwise("NarrativeText")
    )


def partition_text(raw: DataFrame, page_lines: int = PAGE_LINES, first_page: int = 1, outer: bool = False) -> DataFrame:
    """One element per line of ``text``; other columns of ``raw`` are kept.

    A row without text gives no element, or with ``outer`` a row without position.
    """
    kept = [c for c in raw.columns if c != "text"]
    explode = F.posexplode_outer if outer else F.posexplode
    lines = raw.select(*kept, explode(F.split("text", "\n")).alias("element_index", "text"))
    index = F.col("element_index")
    return lines.select(
        *kept,
        "element_index",
        F.concat_ws("-", "doc_id", index).alias("element_uid"),
        line_type(F.col("text"), index).alias("element_type"),
        "text",
        (block_of("element_index", page_lines) + first_page).alias("page_number"),
    )


def partition_html(raw: DataFrame, outer: bool = False) -> DataFrame:
    """One element per block, table and picture of ``html``, with their metadata.

    Blocks come from a stack of open elements (``functions/html.py``): text after a nested
    block belongs to the element around it again, and text outside of all, as on a page
    without markup, is an element of its own.  An outermost table is one element with its
    HTML; a picture follows the block that holds it, with its alternative text.  The depth
    of a heading is its level, that of a list item the nesting of its list, both from 0.
    Empty blocks are dropped inside the array before it is exploded, so positions are dense
    without a window.  A page in which nothing is visible has no elements, or with
    ``outer`` a row without position: see :func:`quarantine`.
    """
    kept = [c for c in raw.columns if c != "html"]
    explode = F.posexplode_outer if outer else F.posexplode
    exploded = raw.select(*kept, explode(blocks(F.col("html"))).alias("element_index", "b"))
    tag = F.col("b.tag")
    heading = tag.isin(*HEADINGS)
    kind = F.when(heading, "Title").otherwise(DEFAULT_TYPE)
    for name, value in TAG_TYPES.items():
        kind = F.when(tag == name, value).otherwise(kind)
    return exploded.select(
        *kept,
        "element_index",
        F.concat_ws("-", "doc_id", "element_index").alias("element_uid"),
        kind.alias("element_type"),
        F.col("b.text").alias("text"),
        F.when(heading, F.substring(tag, 2, 1).cast("int") - 1).otherwise(F.col("b.depth")).alias("category_depth"),
        F.col("b.links.url").alias("link_urls"),
        F.col("b.links.text").alias("link_texts"),
        F.col("b.strong.text").alias("emphasized_text_contents"),
        F.col("b.strong.tag").alias("emphasized_text_tags"),
        truthy_text(F.col("b.src")).alias("image_url"),
        F.when(tag == "table", F.col("b.html")).alias("text_as_html"),
    )


def quarantine(raw: DataFrame, body: str) -> DataFrame:
    """The rows of ``raw`` that give no elements, with the reason: all their columns, ``reason``.

    ``body`` is ``text``, ``html`` or ``json``.  Every row gives elements or is listed here.
    """
    missing = F.when(F.col(body).isNull(), f"no {body}")
    if body == "html":
        reason = missing.when(F.size(blocks(F.col(body))) == 0, "nothing visible")
    elif body == "json":
        e = F.from_json(body, element_schema())
        reason = missing.when(e["doc_id"].isNull(), "not an element with a document number")
    else:
        reason = missing
    return raw.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def number_pages(elements: DataFrame, first_page: int = 1) -> DataFrame:
    """``page_number`` from page breaks: a break opens the next page.  One shuffle."""
    breaks = F.when(F.col("element_type") == PAGE_BREAK, 1).otherwise(0)
    counted = running_sum(elements.drop("page_number"), ["doc_id"], "element_index", breaks, "__breaks")
    return counted.withColumn("page_number", (F.col("__breaks") + first_page).cast("int")).drop("__breaks")


def fill_parents(elements: DataFrame, levels: int = HEADING_LEVELS, block: int = BLOCK) -> DataFrame:
    """``parent_id``: the heading that an element stands under.  One shuffle.

    A Title hangs on the nearest earlier Title of smaller ``category_depth`` (NULL is 0), so
    a later chapter does not hang on an earlier section; other elements hang on the nearest
    earlier Title.  The latest Title of each level is all that a block of positions passes
    on; depths from ``levels`` on count as the deepest level.
    """
    depth = F.least(F.greatest(F.coalesce(_depth(elements), F.lit(0)), F.lit(0)), F.lit(levels - 1))
    heading = F.col("element_type") == "Title"
    own = F.struct(F.col("element_index").alias("at"), F.col("element_uid").alias("uid"))
    names = [f"__level_{k}" for k in range(levels)]
    latest = {n: F.when(heading & (depth == k), own) for k, n in enumerate(names)}
    known = last_before(elements.drop("parent_id"), ["doc_id"], "element_index", latest, block=block)
    above = F.when(heading, F.slice(F.array(*names), 1, depth)).otherwise(F.array(*names))
    return known.withColumn("parent_id", F.array_max(above)["uid"]).drop(*names)


def _depth(elements: DataFrame) -> Column:
    return F.col("category_depth") if "category_depth" in elements.columns else F.lit(None).cast("int")


def detect_languages(
    elements: DataFrame, stop_words: dict[str, tuple[str, ...]] | None = None, profiles: Profiles | None = None
) -> DataFrame:
    """``language`` of each element: by stop words, or by profiles where they are given.

    With profiles (``functions/language.py``) all languages of an element are found:
    ``languages`` lists them, the most probable first, and ``language_probabilities`` how
    probable they are.
    """
    if profiles is None:
        return elements.withColumn("language", language_of(F.col("text"), stop_words or STOP_WORDS))
    kept = [c for c in elements.columns if c not in ("languages", "language", "language_probabilities")]
    found = elements.withColumn("__found", languages_of(F.col("text"), profiles))
    return found.select(
        *kept,
        first_code(F.col("__found")).alias("language"),
        codes_of(F.col("__found")).alias("languages"),
        F.col("__found.probability").alias("language_probabilities"),
    )


def apply_flags(elements: DataFrame, include_tables: bool = True, include_images: bool = True) -> DataFrame:
    """Leave out picture elements, or the HTML form of tables."""
    out = elements
    if not include_images:
        out = out.filter(~F.col("element_type").isin(*IMAGE_TYPES))
    if not include_tables:
        out = out.withColumn("text_as_html", F.lit(None).cast("string"))
    return out


def choose_parse(raw: DataFrame, specific: str = "specific_text", generic: str = "generic_text") -> DataFrame:
    """Envelope: the specific parse where there is one, else the generic, else an error.

    Adds ``text``, ``status``, ``method`` and ``error``; filter on ``status`` to part the
    good documents from the quarantine.
    """
    text = F.coalesce(F.col(specific), F.col(generic))
    failed = text.isNull()
    return raw.select(
        *[c for c in raw.columns if c not in (specific, generic, "method")],
        text.alias("text"),
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(F.col(specific).isNull(), "open_source_local").otherwise(F.col("method")).alias("method"),
        F.when(failed, "no parser could read the document").alias("error"),
    )


def partition_status(raw: DataFrame) -> DataFrame:
    """One envelope row per document; the element count is NULL for a failed one."""
    chosen = choose_parse(raw)
    return chosen.select(
        "doc_id",
        "status",
        "method",
        "error",
        F.when(F.col("status") == "success", F.size(F.split("text", "\n"))).alias("element_count"),
    )


def elements_from_json(rows: DataFrame, column: str = "json", extra: str | None = None) -> DataFrame:
    """Elements from JSON objects with the canonical field names.

    Rows that are no such object, or have no ``doc_id``, are left to :func:`quarantine`.
    ``extra`` names a column for the members that are no canonical field: a map from their
    names to VARIANT values, NULL without any, which ``elements_to_json`` puts back.
    """
    # A filter on a member would be pushed below and parse the object once more.
    given = lambda e: e["doc_id"].isNotNull()
    parsed = F.from_json(column, element_schema())
    if extra is None:
        return rows.select(F.inline(F.filter(F.array(parsed), given)))
    members = unknown_members(F.col(column)).alias(extra)
    whole = F.struct(parsed.alias("e"), members)
    return rows.select(F.inline(F.filter(F.array(whole), lambda x: given(x["e"])))).select("e.*", extra)


def unknown_members(json: Column) -> Column:
    """Members of a JSON object that are no canonical field, as a map of VARIANT values.

    Values keep their types and nesting; the text they are written as later has no blanks,
    object members by name and numbers in their shortest form.
    """
    names = F.array_except(F.json_object_keys(json), F.array(*[F.lit(c) for c in ELEMENT_COLUMNS]))

    def path(name: Column) -> Column:
        quote = F.when(F.contains(name, F.lit("'")), '"').otherwise("'")
        return F.concat(F.lit("$["), quote, name, quote, F.lit("]"))

    def members(all_names: Column) -> Column:
        value = F.try_parse_json(json)
        return bind(value, lambda v: F.map_from_arrays(all_names, F.transform(all_names, lambda n: F.try_variant_get(v, path(n), "variant"))))

    return bind(F.array_sort(names), lambda n: F.when(F.size(n) > 0, members(n)))


def elements_to_json(extra: str | None = None) -> Column:
    """The JSON object of a row's canonical fields, followed by the members in ``extra``."""
    known = F.to_json(F.struct(*ELEMENT_COLUMNS))
    if extra is None:
        return known
    more = F.to_json(F.col(extra))
    joined = F.concat(F.left(known, F.length(known) - 1), F.when(known != "{}", ",").otherwise(""), F.substr(more, F.lit(2)))
    return F.when(F.size(extra) > 0, joined).otherwise(known)
