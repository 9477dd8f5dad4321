"""Element tables that Spark derives from the given tables, for queries and tests.

``documents`` have lines but few kinds of metadata, so ``rich_elements`` decorates each
line by rules on the document number and the position.  All lines are used, and whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.images import encode_base64, image_hash
from quire.schema import conform
from quire.sources.documents import partition_html, partition_text


# Schemas of the given tables; naming them saves a job that only reads footers.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


def text_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_text(raw_documents(spark, sf_dir))


def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages; of three, one gets a table, some text and a picture at its end, and one
    nested lists and tables, other quotes and names, and text around a block.
    """
    pages = table(spark, sf_dir, "pages")
    simple = F.concat(F.lit("<table><tr><td>"), "url", F.lit('</td><td>2</td></tr></table>&#8364; &lt;tail&gt; <img src="i.png?a=1&amp;b=2" alt="A &amp; B">'))
    nested = F.concat(
        F.lit("<ul><li>out <a href='u1' title=\"a>b\">one</a><ol><li>in <strong>&Uuml;n&iuml;</strong></ol>again</li></ul>"),
        F.lit('<table><tr><td>a<table><tr><td><a href="u 2">'), "url", F.lit("</a></td></tr></table></td><td>b</td></tr></table>"),
        F.lit("<div>lead<p><em>para</em></p>trail <IMG alt='it&apos;s' src=p.png></div>"),
    )
    added = F.when(F.col("page_id") % 3 == 0, simple).when(F.col("page_id") % 3 == 1, nested).otherwise("")
    html = F.concat("html", added)
    return partition_html(pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("source"), html.alias("html")))


def sectioned_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a Title at every ninth position, of four depths, some without one."""
    i = F.col("element_index")
    kind = F.when(i % 9 == 0, "Title").otherwise(F.col("element_type"))
    depth = F.when((i % 9 == 0) & (i % 5 != 3), F.pmod(F.col("doc_id") * 3 + i / 9, F.lit(4)).cast("int"))
    return text_elements(spark, sf_dir).withColumn("element_type", kind).withColumn("category_depth", depth)


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element per page whose text holds its address; documents contain no URLs."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.lit(0).alias("element_index"),
        F.lit("NarrativeText").alias("element_type"),
        F.concat(F.lit("See <"), "url", F.lit("> and http://example.org/a|b.")).alias("text"),
    )


# Decoration rules in SQL: ``d`` is the document number, ``i`` the position, ``kind`` the
# element type and ``line`` the text of the line.
RICH_TYPE = """
    CASE WHEN broken THEN 'PageBreak' WHEN i = 0 THEN 'Title' WHEN i % 10 = 7 THEN 'Table'
         WHEN i % 10 = 9 THEN 'Image' WHEN i % 20 = 8 THEN 'FigureCaption' WHEN i % 20 = 18 THEN 'Picture'
         WHEN i % 10 = 1 AND d % 5 = 0 THEN 'Header' WHEN i % 10 = 2 AND d % 5 = 1 THEN 'Footer' ELSE element_type END"""
_SITE = "concat('https://example.org/', d, '/', i)"
_PICTURE = "kind IN ('Image', 'Picture', 'FigureCaption')"
_MAIL = "source = 'src3' AND i = 0"
RICH_COLUMNS = {
    "doc_id": "d",
    "source": "source",
    "element_index": "i",
    "element_uid": "element_uid",
    "element_type": "kind",
    "text": "line",
    "page_number": "IF(d % 11 <> 0, page_number, NULL)",
    "page_name": "IF(kind = 'Table' AND d % 7 = 0, concat('Sheet', i div 10 + 1), NULL)",
    "category_depth": "IF(kind = 'ListItem' OR (kind = 'Title' AND d % 13 <> 0), int(d % 3), NULL)",
    "parent_id": "IF(i > 0, concat(d, '-0'), NULL)",
    "languages": "IF(i % 8 <> 6, array(lang, 'eng'), NULL)",
    "emphasized_text_contents": "IF(i % 4 = 0, array(substring(line, 1, 5)), NULL)",
    "emphasized_text_tags": "IF(i % 4 = 0, array('b'), NULL)",
    "links": f"IF(i % 6 = 0, array(struct({_SITE} AS url, 'site' AS text)), NULL)",
    "link_urls": f"IF(i % 9 = 4, array(concat({_SITE}, '?a=1&b=2'), concat({_SITE}, '#top')), NULL)",
    "link_texts": "IF(i % 9 = 4, array('first <link>'), NULL)",
    "image_base64": rf"IF({_PICTURE} AND d % 6 <> 5, translate(base64(encode(concat(repeat('~', IF(d % 3 = 0, 900, 0)), line), 'UTF-8')), '\r\n', ''), NULL)",
    "image_mime_type": f"IF({_PICTURE}, CASE d % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' END, NULL)",
    "image_url": f"IF(i % 30 = 9, concat({_SITE}, '.png'), NULL)",
    "image_path": "IF(i % 30 = 19, concat('img/', d, '-', i), NULL)",
    "url": f"IF(d % 8 = 1, {_SITE}, NULL)",
    "text_as_html": "IF(kind = 'Table' AND d % 4 <> 3, concat('<table><tr><td>', replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</td></tr></table>'), NULL)",
    "sent_from": f"IF({_MAIL}, concat('a', d, '@example.org'), NULL)",
    "sent_to": f"IF({_MAIL}, 'b@example.org', NULL)",
    "subject": f"IF({_MAIL}, substring(line, 1, 20), NULL)",
    "header_footer_type": "IF(kind IN ('Header', 'Footer'), 'primary', NULL)",
    "section": "IF(d % 9 = 0, concat('s', i div 10), NULL)",
    "detection_class_prob": "double(i % 10) / 10",
    "coordinates": "IF(i % 15 = 3, concat('(', i, ',', d, ')'), NULL)",
    "filename": "IF(d % 4 = 1, concat('file_', d, '.txt'), NULL)",
    "filetype": "IF(d % 2 = 0, 'text/plain', NULL)",
}


def rich_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, decorated by rules; after each tenth line a page break row without text.

    Payloads of every third document begin alike for more than a thousand characters.
    """
    each = text_elements(spark, sf_dir).selectExpr(
        "doc_id", "source", "lang", "element_type", "element_index AS at",
        "inline(IF(element_index % 10 = 9, array(struct(text AS line, 0 AS more), struct('' AS line, 1 AS more)), array(struct(text AS line, 0 AS more))))",
    )
    lines = each.selectExpr(
        "doc_id AS d", "int(at + at div 10 + more) AS i", "source", "lang", "element_type", "line", "more = 1 AS broken"
    ).selectExpr("*", "concat(d, '-', i) AS element_uid", "int(i div 5) + 1 AS page_number")
    typed = lines.selectExpr("*", f"{RICH_TYPE} AS kind")
    return conform(typed.selectExpr(*[f"{rule} AS {name}" for name, rule in RICH_COLUMNS.items()]))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines of a document make a slide, each line a shape.

    The shapes of a slide are five array slots of one document row, so no grouping is
    needed to build them.
    """
    raw = raw_documents(spark, sf_dir)
    lines = F.split("text", "\n")
    count = F.ceil(F.size("lines") / 5).cast("int")
    numbered = raw.select("doc_id", lines.alias("lines")).select(
        "doc_id", "lines", F.explode(F.sequence(F.lit(1), count)).alias("slide")
    )
    d = F.col("doc_id")
    own = F.slice("lines", (F.col("slide") - 1) * 5 + 1, F.lit(5))
    payload = lambda t: encode_base64(t.cast("binary"))
    none = F.lit(None)

    def child(k: int, name: Column, image: Column) -> Column:
        return F.struct(
            F.lit(k).alias("shape_index"),
            name.cast("string").alias("name"),
            image.cast("string").alias("image_base64"),
            F.lit("image/png").alias("content_type"),
            F.lit(10).cast("long").alias("width"),
            F.lit(20).cast("long").alias("height"),
        )

    def shape(t: Column, k: Column) -> Column:
        image = F.when(k == 2, payload(t))
        return F.struct(
            k.alias("shape_index"),
            F.when(k == 3, 6).when(k == 2, 13).otherwise(17).alias("shape_type"),
            F.when(d % 3 != 0, F.concat(F.lit("Shape "), k.cast("string"))).alias("name"),
            F.when((k == 1) & (d % 10 == 0), F.lit("  ")).otherwise(t).alias("text"),
            (k != 2).alias("has_text_frame"),
            (k * 400000).cast("long").alias("top"),
            # Every fourth slide has no placeholders.
            F.when(F.col("slide") % 4 == 1, None).when(k == 1, 4).when(k == 2, 12).when(k == 3, 13).when(k == 4, 4).cast("int").alias("placeholder_type"),
            ((k == 1) & (d % 2 == 0)).alias("has_table"),
            image.alias("image_base64"),
            F.when(k == 2, "image/jpeg").alias("content_type"),
            none.cast("string").alias("ext"),
            F.lit(100).cast("long").alias("width"),
            none.cast("long").alias("height"),
            F.when(
                k == 3, F.array(child(0, F.when(d % 2 == 0, F.lit("child")), payload(t)), child(1, none, none))
            ).alias("children"),
        )

    notes = F.when(F.col("slide") % 2 == 0, F.when(F.col("slide") % 4 == 0, "  ").otherwise(F.concat(F.lit("Notiz "), F.col("slide").cast("string"))))
    return numbered.select(
        "doc_id",
        "slide",
        F.concat(F.lit("Layout "), (F.col("slide") % 4).cast("string")).alias("layout_name"),
        notes.alias("notes"),
        F.transform(own, shape).alias("shapes"),
    )


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout names by slide: every third is missing, every fifth comes twice."""
    s = slides(spark, sf_dir).select("doc_id", "slide", "layout_name").filter(F.col("slide") % 3 != 0)
    again = F.when(F.col("slide") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return s.select("doc_id", "slide", "layout_name", F.explode(again).alias("ord")).withColumn(
        "layout_name", F.when(F.col("ord") == 1, F.lit("Second")).otherwise(F.col("layout_name"))
    )


def image_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description for each picture whose hash ends in a digit.

    Digit 0 gives the caption back, which does not count as a description.
    """
    pictures = rich_elements(spark, sf_dir).filter(F.col("image_base64").isNotNull())
    hashed = pictures.select(image_hash(F.col("image_base64")).alias("image_hash"), "text")
    last = F.substring("image_hash", -1, 1)
    return (
        hashed.filter(last.between("0", "9"))
        .groupBy("image_hash")
        .agg(F.min("text").alias("caption"))
        .select(
            "image_hash",
            F.when(last == "0", F.col("caption")).otherwise(F.concat(F.lit("Bild "), F.substring("image_hash", 1, 6))).alias("description"),
            F.when(last <= "4", "m1").otherwise("m2").alias("model"),
            F.when(last <= "4", F.lit(0.003)).otherwise(F.lit(0.01)).alias("cost_estimate"),
        )
    )


# File extensions by document number modulo 12.
FILE_EXTENSIONS = ("pdf", "PDF", "docx", "pptx", "ppt", "xlsx", "xls", "jpg", "webp", "txt", "html", "md")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in FILE_EXTENSIONS])
    docs = table(spark, sf_dir, "documents")
    ext = F.get(names, (F.col("doc_id") % 12).cast("int"))
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        F.col("n_chars").alias("length"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for every third file, and labels for files that do not exist."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    names = F.array(*[F.lit(x) for x in FILE_EXTENSIONS])
    d = F.col("doc_id").cast("string")
    known = docs.filter(F.col("doc_id") % 3 == 0).select(
        F.concat(F.lit("Doc "), d).alias("label"),
        F.concat(F.lit("doc_"), d, F.lit("."), F.get(names, (F.col("doc_id") % 12).cast("int"))).alias("filename"),
    )
    missing = docs.filter(F.col("doc_id") % 5 == 0).select(
        F.concat(F.lit("Lost "), d).alias("label"), F.concat(F.lit("lost_"), d, F.lit(".pdf")).alias("filename")
    )
    return known.unionByName(missing)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture for every line, some without bytes, name or type."""
    d, i = F.col("doc_id"), F.col("element_index")
    lines = text_elements(spark, sf_dir)
    return lines.select(
        "doc_id",
        "element_index",
        F.when(i % 15 != 4, F.col("page_number")).alias("page_number"),
        F.when(i % 10 != 9, F.concat(F.lit("pic"), i.cast("string"))).alias("name"),
        F.when(d % 6 != 5, F.col("text").cast("binary")).alias("blob"),
        F.when(d % 5 == 0, "image/png").when(d % 5 == 1, "image/webp").alias("content_type"),
        F.when(d % 5 == 2, "PNG").when(d % 5 == 3, "gif").otherwise("tiff").alias("ext"),
    )


class PictureHook:
    """A user's parser: a picture row with bytes is an element, one without is none."""

    def iter_elements(self, row: dict):
        import base64

        if row["blob"]:
            kind = row["content_type"] or {"png": "image/png", "gif": "image/gif"}.get((row["ext"] or "").lower(), "image/jpeg")
            yield {
                "element_index": row["element_index"],
                "element_type": "Image",
                "text": row["name"] or "PowerPoint-Bild",
                "page_number": row["page_number"] or 1,
                "image_base64": base64.b64encode(row["blob"]).decode(),
                "image_mime_type": kind,
            }


def with_unknown_members() -> Column:
    """A rich element as JSON, with members of several types that are no canonical field."""
    i = F.col("element_index")
    more = [
        F.when(i % 2 == 0, F.struct(i.alias("b"), F.col("element_type").alias("a"))).alias("x_nested"),
        F.when(i % 3 == 0, F.array(F.lit("p"), F.left("text", F.lit(7)))).alias("it's"),
        F.when(i % 3 == 0, i % 2 == 1).alias("x_flag"),
        F.when(i % 3 == 0, "7").alias("x_text"),
    ]
    return F.to_json(F.struct("doc_id", "element_index", "element_type", "text", *more))


def flawed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Documents without text, JSON that is broken, and pages that show nothing, by body."""
    d, p = F.col("doc_id"), F.col("page_id")
    raw = raw_documents(spark, sf_dir)
    json = F.to_json(F.struct("doc_id", "text"))
    pages = table(spark, sf_dir, "pages")
    return {
        "text": raw.withColumn("text", F.when(d % 13 != 5, F.col("text"))),
        "json": raw.select("doc_id", "source", F.when(d % 13 == 5, None).when(d % 7 == 2, F.left(json, F.lit(9))).otherwise(json).alias("json")),
        "html": pages.select(
            p.alias("doc_id"),
            F.col("url").alias("source"),
            F.when(p % 13 == 5, None).when(p % 13 == 6, "<div><script>x</script> &#32;</div>").otherwise(F.col("html")).alias("html"),
        ),
    }


def parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose own parser failed for some, and the generic one for fewer."""
    d = F.col("doc_id")
    return raw_documents(spark, sf_dir).select(
        "doc_id",
        F.lit("open_source_pdf_optimized_no_forms").alias("method"),
        F.when(d % 7 != 3, F.col("text")).alias("specific_text"),
        F.when(d % 21 != 3, F.col("text")).alias("generic_text"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three uploads (doc_id, upload, source, text): all documents; every third with a line
    before its text and every fifth deleted; and some of the first ones again, late.
    """
    d = F.col("doc_id")
    raw = raw_documents(spark, sf_dir)
    first = raw.select("doc_id", F.lit(1).cast("long").alias("upload"), "source", "text")
    text = F.when(d % 5 != 0, F.concat(F.lit("Neue Fassung\n"), "text"))
    second = raw.select("doc_id", F.lit(2).cast("long").alias("upload"), "source", text.alias("text"), ((d % 3 == 0) | (d % 5 == 0)).alias("changed"))
    again = first.withColumn("changed", d % 7 == 0)
    return [first, *[x.filter("changed").drop("changed") for x in (second, again)]]
