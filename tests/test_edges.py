"""Literal edge rows that generated tables do not hold."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions.images import redact_data_urls, with_image_hashes
from quire.functions.text import clean_whitespace, language_of, strip, table_csv
from quire.operators import elements as el, export, images, rag, render, slides as sl, text as tx
from quire.sources import documents as docs, files as fl, slides as sp

B64 = base64.b64encode(b"picture").decode()


def values(df, column="text"):
    return [r[column] for r in df.orderBy("element_index").collect()]


def scalar(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_blank_texts_are_dropped_but_kept_by_cleaning(make):
    e = make(*[{"text": t, "element_type": "Text"} for t in ("   ", "\n\n", " ", "a", None)])
    assert values(el.nonempty(e)) == ["a"]
    assert tx.clean_text(e).count() == 5
    assert el.text_metrics(e).first().total_elements == 5
    assert el.text_metrics(e).first().total_characters == 2


def test_metrics_of_nothing(make):
    m = el.text_metrics(make({"text": " ", "element_type": "Text"})).first()
    assert (m.total_words, m.total_sentences, m.average_element_length) == (0, 0, 0.0)


def test_title_without_depth(make):
    e = make({"text": "T", "element_type": "Title"})
    assert '<h2 style="margin-left: 0px; color: #333;">T</h2>' in render.render_html(e).first().html
    assert render.render_markdown(e).first().markdown == "## T"


def test_html_is_closed_and_escaped(make):
    html = render.render_html(make({"text": "a <b> & c", "element_type": "Text"})).first().html
    assert html.startswith('<div class="document-content">\n') and html.endswith("\n</div>")
    assert "<p>a &lt;b&gt; &amp; c</p>" in html


def test_image_without_page_uses_position(make):
    e = make({"text": "", "element_type": "Text"}, {"text": "x", "element_type": "Image", "image_base64": B64})
    row = images.image_manifest(e).first()
    assert row.page == 1 and row.filename.startswith("page_001_hash_") and row.filename.endswith(".png")
    assert row.size_bytes == 7


def test_bad_payload_counts_but_is_not_written(make):
    e = make(
        {"text": "x", "element_type": "Image", "image_base64": "@@@"},
        {"text": "y", "element_type": "Image", "image_base64": B64},
    )
    assert images.image_files(e).count() == 1
    s = images.manifest_summary(e).first()
    assert (s.total_images, s.images_included, s.status) == (2, 1, "success")


def test_document_without_images_is_a_warning(make):
    assert images.manifest_summary(make({"text": "x", "element_type": "Text"})).first().status == "warning"


def test_copies_share_a_name_and_are_ranked(make):
    """Pictures that begin alike have names of their own; only copies share one."""
    long = "A" * 1200
    picture = {"element_type": "Picture", "page_number": 3, "text": "p"}
    e = make(*[{**picture, "image_base64": long + x} for x in ("AAAA", "BBBB", "AAAA")])
    rows = images.ranked_manifest(e).orderBy("element_index").collect()
    assert rows[0].filename == rows[2].filename != rows[1].filename
    assert [r.name_rank for r in rows] == [1, 1, 2]
    files = {r.filename: bytes(r.content) for r in images.image_files(e).collect()}
    assert len(files) == 2 and len(set(files.values())) == 2
    joined = rag.image_references(rag.rag_documents(e), images.image_manifest(e)).orderBy("element_index").collect()
    assert [r.filename for r in joined] == [r.filename for r in rows]


def test_hash_scopes_never_meet(make):
    e = make({"text": "x", "element_type": "Image", "image_base64": B64})
    assert rag.orphan_references(rag.inline_rag(e), images.image_manifest(e, "prefix")).count() == 1
    assert rag.orphan_references(rag.inline_rag(e), images.image_manifest(e)).count() == 0
    assert rag.image_references(rag.rag_documents(e), images.image_manifest(e)).first().filename


def test_stored_hashes_replace_the_payload(make):
    e = make({"text": "x", "element_type": "Image", "image_base64": B64}, {"text": "y", "element_type": "Text"})
    stored = with_image_hashes(e)
    assert rag.rag_jsonl(rag.rag_documents(stored)).collect() == rag.rag_jsonl(rag.rag_documents(e)).collect()
    plan = rag.rag_jsonl(rag.rag_documents(stored.drop("image_base64")))._jdf.queryExecution().optimizedPlan().toString()
    assert "image_base64" not in plan.split("Project")[1]


def test_empty_lists_are_absent(make):
    e = make(
        {"text": "a", "element_type": "Text", "languages": []},
        {"text": "b", "element_type": "Text", "languages": None},
        {"text": "c", "element_type": "Text", "languages": ["deu"], "detection_class_prob": 0.0},
    )
    assert values(el.language_rows(e), "element_index") == [2]
    assert [r.detection_class_prob for r in el.element_details(e).collect()] == [None] * 3
    assert rag.rag_rows(e).filter("language is null").count() == 2


def test_absent_keys_are_left_out_of_json(make):
    e = make({"text": "ä \"q\"", "element_type": "Text", "page_number": 0})
    line = rag.rag_jsonl(rag.rag_documents(e)).first().line
    assert line == '{"metadataAttributes":{"source":"a.txt","element_index":0,"element_type":"Text"},"content":"ä \\"q\\""}'


def test_email_row_with_only_a_subject(make):
    e = make({"text": "a", "element_type": "Text", "subject": "s"}, {"text": "b", "element_type": "Text", "sent_from": ""})
    assert [r.subject for r in el.email_rows(e).collect()] == ["s"]


def test_contacts_in_one_element(make):
    text = "mail a@example.org or b.c@example.com, host 10.0.0.1, call (212) 555-0100, see http://x.org/a " + "z" * 200
    rows = tx.contacts(make({"text": text, "element_type": "Text"})).collect()
    assert sorted(r.kind for r in rows) == ["email", "email", "ip", "phone", "url"]
    assert {len(r.context) for r in rows} == {100}
    totals = tx.contact_totals(make({"text": text, "element_type": "Text"})).first()
    assert (totals.total_emails, totals.total_phones, totals.total_ips, totals.total_urls) == (2, 1, 1, 1)


def test_table_csv(spark):
    assert scalar(spark, table_csv(F.lit("a  b\n\n c\td"))) == "a,b\nc,d"


def test_redaction_keeps_alt_text(spark):
    text = "x ![one](data:image/png;base64,AA==) y ![two](data:image/jpeg;base64,BB==)"
    assert scalar(spark, redact_data_urls(F.lit(text))) == "x 🖼️ [Bild: one] y 🖼️ [Bild: two]"


def test_strip_takes_what_python_takes(spark):
    for text in (" a　", "\x1ca\x85", "a b ", "​a", ""):
        assert scalar(spark, strip(F.lit(text))) == text.strip()


def test_clean_whitespace(spark):
    assert scalar(spark, clean_whitespace(F.lit(" a \n b  c "))) == "a b c"


def test_language_ties_go_by_code(spark):
    assert scalar(spark, language_of(F.lit("der the"))) == "deu"
    assert scalar(spark, language_of(F.lit("the and der"))) == "eng"
    assert scalar(spark, language_of(F.lit("xyz"))) == "und"


def test_emphasis_in_order_and_not_for_empty_phrases(spark):
    phrases = F.array(F.lit("a"), F.lit(""), F.lit("b"))
    assert scalar(spark, markup.emphasize(F.lit("ab a"), phrases, markup.MD_STRONG)) == "**a****b** **a**"


def test_markdown_links(make):
    link = [("http://u", None)]
    rows = [
        {"text": "t", "element_type": "Title", "links": link, "category_depth": 9},
        {"text": "l", "element_type": "ListItem", "links": link, "category_depth": 1},
        {"text": "h", "element_type": "Header", "links": link},
        {"text": "n", "element_type": "NarrativeText", "links": link + link},
        {"text": "x", "element_type": "Text", "link_urls": ["http://a", "http://b"], "link_texts": ["A"]},
    ]
    parts = render.render_markdown(make(*rows)).first().markdown.split("\n\n")
    parts = [p for p in parts if not p.startswith("> 📊")]
    assert parts == [
        "###### t", "🔗 <http://u>", "  - l", "    🔗 <http://u>", "> **HEADER:** h",
        "n", "[^1]: http://u", "[^2]: http://u", "x [A](http://a) [Link](http://b)",
    ]


def test_plain_renders_hide_images_and_badges(make):
    e = make({"text": "cap", "element_type": "Image", "image_base64": B64, "page_number": 2}, {"text": "t", "element_type": "Text", "page_number": 2})
    html = render.render_html(e, False, False).first().html
    assert B64 not in html and "S.2" not in html and "[Bild ohne Base64-Daten: cap]" in html
    assert B64 in render.render_html(e).first().html


def test_table_without_html(make):
    e = make({"text": "a b", "element_type": "Table", "page_number": 4})
    assert render.render_markdown(e).first().markdown == "> 📊 Tabelle - Seite 4\n\n```\na b\n```"
    assert "<pre>a b</pre>" in render.render_html(e).first().html


def test_vision_descriptions(spark, make):
    rows = [{"text": t, "element_type": "Image", "image_base64": p} for t, p in (("a", "AAAA"), ("b", "BBBB"), ("c", "CCCC"), ("d", None))]
    e = make(*rows, {"text": "e", "element_type": "Text"})
    hashes = [r.image_hash for r in rag.rag_rows(e).orderBy("element_index").collect()]
    given = spark.createDataFrame(
        [(hashes[0], "a house", None, None), (hashes[1], "b", "m", 0.1)],
        "image_hash string, description string, model string, cost_estimate double",
    )
    out = rag.rag_documents(e, given).orderBy("element_index").collect()
    assert [r.content for r in out] == [
        "a\n\n[Vision-Beschreibung]: a house",
        "b",
        "c\n\n[Hinweis: Vision-API nicht verfügbar - Bild nicht beschrieben]",
        "d",
        "e",
    ]
    assert [r.image_described for r in out] == [True, False, False, False, None]
    assert (out[0].vision_model, out[0].vision_cost_estimate) == (None, None)
    stats = rag.image_stats(rag.rag_documents(e, given)).first()
    assert (stats.total_images, stats.images_described, stats.images_failed) == (4, 1, 3)


def test_vision_fallback(spark, make):
    e = make({"text": "a", "element_type": "Image", "image_base64": B64}, {"text": "b", "element_type": "Text"})
    none = spark.createDataFrame([], "image_hash string, description string, model string, cost_estimate double")
    row = rag.rag_documents(e, none, fallback=True).orderBy("element_index").first()
    assert row.content == "a\n\n[Vision-Beschreibung]: Bild-Element (Typ: image/png)"
    assert (row.image_described, row.vision_model, row.vision_cost_estimate) == (True, "Fallback", 0.0)


def test_rag_pages_without_numbers(make):
    e = make(
        {"text": "a", "element_type": "Title", "languages": ["deu"]},
        {"text": "b", "element_type": "Text", "page_number": 1, "filename": "f"},
        {"text": "c", "element_type": "Text", "page_number": 2},
        {"text": "x", "element_type": "PageBreak"},
    )
    pages = rag.rag_pages(e).orderBy("page_order").collect()
    assert [(p.page, p.content, p.element_count, p.source, p.document_type, p.language) for p in pages] == [
        (1, "a\n\nb", 2, "a.txt", "unknown", "deu"),
        (2, "c", 1, "a.txt", "unknown", None),
    ]
    assert pages[0].element_types == ["Text", "Title"]
    line = rag.rag_pages(e).select(rag.page_json().alias("j")).first().j
    assert json.loads(line)["metadataAttributes"]["element_count"] in (1, 2)


def test_page_breaks_number_pages(make):
    e = make(*[{"text": "", "element_type": k} for k in ("Text", "PageBreak", "Text", "PageBreak")])
    assert values(docs.number_pages(e), "page_number") == [1, 2, 2, 3]
    assert values(docs.number_pages(e, first_page=5), "page_number") == [5, 6, 6, 7]


def test_preview_flags(make):
    e = make(*[{"text": f"t{i}", "element_type": "Text"} for i in range(6)])
    rows = rag.rag_preview(rag.rag_documents(e)).collect()
    assert len(rows) == 5 and all(r.is_preview for r in rows)
    five = rag.rag_preview(rag.rag_documents(e.filter("element_index < 5"))).collect()
    assert len(five) == 5 and not any(r.is_preview for r in five)


def test_unknown_options(make):
    e = make({"text": "a", "element_type": "Text"})
    with pytest.raises(ValueError):
        rag.chunk_hint(e, "other")
    with pytest.raises(ValueError):
        fl.check_strategy("other")
    with pytest.raises(ValueError):
        export.output_files(e, ("pdf",))


def test_picture_hook(spark):
    files = spark.createDataFrame([("A.PPTX", 1)], "path string, length long")
    row = fl.route_files(files, picture_hook=False).first()
    assert (row.method, row.image_support) == ("open_source_pptx_with_picture_partitioner_False", False)


def test_picture_defaults(spark):
    rows = [(1, 0, None, "", b"x", None, "PNG"), (1, 1, 2, "n", b"", "image/png", None), (1, 2, 2, "n", b"y", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, element_index int, page_number int, name string, blob binary, content_type string, ext string")
    out = sp.picture_elements(df).orderBy("element_index").collect()
    assert [(r.text, r.page_number, r.image_mime_type) for r in out] == [("PowerPoint-Bild", 1, "image/png"), ("n", 2, "image/jpeg")]


SHAPE = (
    "shape_index int, shape_type int, name string, text string, has_text_frame boolean, top long, placeholder_type int, "
    "has_table boolean, image_base64 string, content_type string, ext string, width long, height long"
)
CHILD = "shape_index int, name string, image_base64 string, content_type string, width long, height long"


def shape(i, text=None, kind=17, ph=None, image=None, children=None, top=0):
    struct = (i, kind, None, text, True, top, ph, False, image, None, None, None, None)
    return (*struct, children)


def slide(spark, *shapes, notes=None):
    fields = ",".join(f"{n.split()[0]}:{n.split()[1]}" for n in SHAPE.split(", "))
    child = ",".join(f"{n.split()[0]}:{n.split()[1]}" for n in CHILD.split(", "))
    schema = f"doc_id long, slide int, layout_name string, notes string, shapes array<struct<{fields},children:array<struct<{child}>>>>"
    return spark.createDataFrame([(1, 1, "L", notes, list(shapes))], schema)


def test_last_title_and_footer_win(spark):
    s = slide(spark, shape(0, "first"), shape(1, "second"), shape(2, "low", top=2_000_000), shape(3, " ", ph=4), shape(4, "7", ph=12), shape(5, "8", ph=12))
    assert sl.slide_layout(s).first().title_text == "8"
    low = slide(spark, shape(0, "first"), shape(1, "second"), shape(2, "low", top=2_000_000))
    assert sl.slide_layout(low).first().title_text == "second"
    f = sl.slide_footers(s).first()
    assert (f.footer_text, f.slide_number, f.date_text, f.notes) == (None, "8", None, None)
    t = sl.slide_footer_summary(sl.slide_footers(s)).first()
    assert (t.has_footer, t.has_slide_numbers, t.footer_count) == (False, True, 0)


def test_groups_give_one_level_of_pictures(spark):
    child = [(0, None, "AA==", "image/png", 1, 2), (1, "x", None, None, None, None)]
    s = slide(spark, shape(0, image="BB=="), shape(1, kind=6, children=child), shape(2, kind=17, children=child))
    rows = sorted((r.type, r.alt_text) for r in sp.slide_pictures(s).collect())
    assert rows == [("Picture", "Bild auf Slide 1"), ("Picture (Grouped)", "Gruppiertes Bild auf Slide 1")]


def test_slide_html(spark, make):
    e = make({"text": "T", "element_type": "Title", "page_number": 2}, {"text": "h", "element_type": "Header", "page_number": 2}, {"text": "n", "element_type": "Text"})
    layouts = spark.createDataFrame([(1, 2, "B", 1), (1, 2, "A", 0)], "doc_id long, slide int, layout_name string, ord int")
    footers = spark.createDataFrame([(1, 1, "f", "9", "d", "note")], "doc_id long, slide int, footer_text string, slide_number string, date_text string, notes string")
    parts = sl.render_slides(e, layouts, footers).orderBy("slide", "segment").collect()
    html = "\n".join(r.html for r in parts)
    assert html.index("Slide 1<") < html.index("Slide 2<")
    assert '<span class="layout-badge">A</span>' in html and '<span class="layout-badge">Standard</span>' in html
    assert '<div><span class="footer-text">f</span> | <span class="footer-text">📅 d</span></div>\n<span class="slide-number">9</span>' in html
    assert ">h<" not in html and '<div class="notes-text">note</div>' in html


def test_full_json_marks_cut_payload(make):
    e = make({"text": "a", "element_type": "Image", "image_base64": "A" * 101}, {"text": "b", "element_type": "Image", "image_base64": "A" * 100})
    rows = [json.loads(r.json)["metadata"] for r in export.elements_full_json(e).orderBy("element_index").collect()]
    assert rows[0] == {"image_base64": "A" * 100 + "...", "base64_truncated": True}
    assert rows[1] == {"image_base64": "A" * 100, "base64_truncated": False}


def test_quarantine(spark):
    raw = spark.createDataFrame([(1, "m", "a\nb", "x"), (2, "m", None, "y"), (3, "m", None, None)], "doc_id long, method string, specific_text string, generic_text string")
    rows = docs.partition_status(raw).orderBy("doc_id").collect()
    assert [(r.status, r.method, r.element_count) for r in rows] == [("success", "m", 2), ("success", "open_source_local", 1), ("error", "open_source_local", None)]
    assert docs.choose_parse(raw).filter("status = 'error'").count() == 1


@pytest.mark.parametrize("html, expected", [
    ("plain &lt;text&gt;", [("Text", "plain <text>", None, None)]),
    ("lead <p>one</p>", [("Text", "lead", None, None), ("NarrativeText", "one", None, None)]),
    ("<h2>&#72;&#x69; &#128512; &#0; &#xD800; &#99999999;</h2>", [("Title", "Hi 😀 &#0; &#xD800; &#99999999;", None, None)]),
    ("<p>a</p><TABLE><tr><td><p>x</p></td></tr></TABLE><p>b</p>", [
        ("NarrativeText", "a", None, None), ("Table", "x", None, "<TABLE><tr><td><p>x</p></td></tr></TABLE>"), ("NarrativeText", "b", None, None)]),
    ('<p>a<img alt="p &amp; q" src="u?a&amp;b"></p><img src="v">', [
        ("NarrativeText", "a", None, None), ("Image", "p & q", "u?a&b", None), ("Image", "", "v", None)]),
    ("<pre>c</pre><blockquote>q</blockquote><section>s<article>t</article></section>", [("Text", x, None, None) for x in "cqst"]),
    ("&amp;lt; &amp;#65;", [("Text", "&lt; &#65;", None, None)]),
    ("<script>x</script>", []),
    ("", []),
])
def test_html_pages(spark, html, expected):
    raw = spark.createDataFrame([(1, html)], "doc_id long, html string")
    rows = docs.partition_html(raw).orderBy("element_index").collect()
    assert [(r.element_type, r.text, r.image_url, r.text_as_html) for r in rows] == expected
    assert docs.quarantine(raw, "html").count() == (0 if expected else 1)


def test_every_row_gives_elements_or_a_reason(spark):
    texts = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id for r in docs.partition_text(texts).select("doc_id").distinct().collect()} == {1, 3}
    assert [(r.doc_id, r.reason) for r in docs.quarantine(texts, "text").collect()] == [(2, "no text")]
    rows = spark.createDataFrame([(1, '{"doc_id":1}'), (2, '{"doc_id":'), (3, None), (4, "[]"), (5, '{"text":"x"}')], "n long, json string")
    assert docs.elements_from_json(rows).count() == 1
    assert [r.n for r in docs.quarantine(rows, "json").orderBy("n").collect()] == [2, 3, 4, 5]


@pytest.mark.parametrize("text, numbers", [
    ("call 555-123-4567 now", ["555-123-4567"]),
    ("call 212 555 0100", ["212 555 0100"]),
    ("call 212.555.0100.", ["212.555.0100"]),
    ("+1 212 555 0100", ["+1 212 555 0100"]),
    ("(743) 555-3824", ["(743) 555-3824"]),
    ("1-(743)555-3824", ["1-(743)555-3824"]),
    ("not 2125550100, 112-555-0100 or 212-555-01000", []),
    ("", []),
])
def test_phone_notations(make, text, numbers):
    e = make({"text": text, "element_type": "Text"})
    assert [r.value for r in tx.contacts(e, ("phone",)).collect()] == numbers
    assert tx.contact_totals(e).first().total_phones == len(numbers)


def test_first_elements_count_rows(make):
    e = make(*[{"text": f"t{i}", "element_type": "Text", "element_index": 10 + 3 * i} for i in range(7)])
    assert sorted(r.preview for r in el.first_elements(e).collect()) == ["t0", "t1", "t2", "t3", "t4"]


def test_listed_paths_are_files(spark):
    catalog = spark.createDataFrame([("A", "a.pdf"), ("B", "b.pdf"), ("C", "c.pdf")], "label string, filename string")
    files = spark.createDataFrame([("a.pdf", 5), ("a.pdf", 1500), ("b.pdf", 2), ("d.pdf", 1)], "path string, length long")
    assert sorted(r.label for r in fl.existing_files(catalog, files).collect()) == ["A (1,500 bytes)", "B (2 bytes)"]
