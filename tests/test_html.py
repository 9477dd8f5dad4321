"""The HTML partition: quotes, nesting, tables, references, hidden parts."""

import html as stdlib

import pytest
from pyspark.sql import functions as F

from quire.functions import html as markup
from quire.sources import documents as docs


@pytest.fixture(scope="module")
def parsed(spark):
    def parse(*pages):
        raw = spark.createDataFrame(list(enumerate(pages)), "doc_id long, html string")
        out = [[] for _ in pages]
        for r in docs.partition_html(raw).orderBy("doc_id", "element_index").collect():
            assert r.element_index == len(out[r.doc_id])
            out[r.doc_id].append(r)
        return out

    return parse


def rows(found):
    return [(r.element_type, r.text) for r in found]


def test_quotes_of_attributes(parsed):
    [found] = parsed("""<p><a href='u1'>x</a> <a href=u2>y</a> <a title='q>' HREF = "u 3&amp;4">z</a><img src=p.png alt='it&apos;s'><img alt="a>b" src='q'></p>""")
    assert found[0].link_urls == ["u1", "u2", "u 3&4"] and found[0].link_texts == ["x", "y", "z"]
    assert [(r.image_url, r.text) for r in found[1:]] == [("p.png", "it's"), ("q", "a>b")]
    same = parsed('<p title="a>b">t</p>', "<p title='</p>'>t</p>", '<p data-x="href=\'no\'">t</p>', "<p don't>t</p>", '<p x="1" y = >t</p>')
    assert [rows(f) for f in same] == [[("NarrativeText", "t")]] * 5


def test_an_anchor_needs_its_own_href(parsed):
    [found] = parsed("""<p><a name="href='no'">a</a><a data-href="no">b</a><a>c</a><abbr href="no">d</abbr><a href="">e</a></p>""")
    assert found[0].link_urls == [""] and found[0].link_texts == ["e"]


def test_emphasis(parsed):
    [found, cells] = parsed("<p>a <strong>s &amp; t</strong> <EM class='x'>e</EM> <i></i> <body2>n</body2> <b>un", "<table><tr><td><b>x<td>y</table>")
    assert found[0].emphasized_text_contents == ["s & t", "e", "un"] and found[0].emphasized_text_tags == ["strong", "em", "b"]
    assert cells[0].emphasized_text_contents == ["x"]


def test_nested_lists(parsed):
    [found, late] = parsed(
        "<ul><li>1<ul><li>2<ol><li>3</ol>2b</ul>1b<li>4<p>in 4</p></ul>out", "<ol><li>a</li></li><li>b<div>c</div></li></ol><li>d"
    )
    assert [(r.element_type, r.text, r.category_depth) for r in found] == [
        ("ListItem", "1", 0), ("ListItem", "2", 1), ("ListItem", "3", 2), ("ListItem", "2b", 1), ("ListItem", "1b", 0), ("ListItem", "4", 0),
        ("NarrativeText", "in 4", None), ("Text", "out", None),
    ]
    assert [(r.text, r.category_depth) for r in late] == [("a", 0), ("b", 0), ("c", None), ("d", 0)]


def test_tables(parsed):
    inner = "<table><tr><td>i<p>j</p></td></tr></table>"
    outer = f"<TABLE id='t>'><tr><td>o{inner}</td><td><img src=a></td></tr></TABLE>"
    [nested, open_, two] = parsed(f"<p>a{outer}b<p>c", "<table><tr><td>x</td>", "<table><tr><td>1</table></table>t<table><tr><td>2</table>")
    assert rows(nested) == [("NarrativeText", "a"), ("Table", "o i j"), ("Image", ""), ("Text", "b"), ("NarrativeText", "c")]
    assert nested[1].text_as_html == outer and nested[2].image_url == "a"
    assert rows(open_) == [("Table", "x")] and open_[0].text_as_html == "<table><tr><td>x</td>"
    assert rows(two) == [("Table", "1"), ("Text", "t"), ("Table", "2")]


def test_text_around_blocks(parsed):
    [found, heads] = parsed("<div>lead<p>para</p>trail</div>after", "<h1>a<h2>b</h1>c<p>d<h3>e")
    assert rows(found) == [("Text", "lead"), ("NarrativeText", "para"), ("Text", "trail"), ("Text", "after")]
    assert [(r.element_type, r.text, r.category_depth) for r in heads] == [
        ("Title", "a", 0), ("Title", "b", 1), ("Text", "c", None), ("NarrativeText", "d", None), ("Title", "e", 2)
    ]


def test_what_is_hidden(parsed):
    found = parsed(
        "<p>a<!-- <p>x</p> -->b<script>var t='</p>'</script>c<STYLE>p{}</style></p>", "<head><title>t</title><p>shown", "<template><p>x</p></template>y",
        "<!doctype html><?xml x?>z<!-- never closed <p>x", "<script>never closed", "<p title='<!-- x'>kept</p>", "</script>k", "<p>a<p",
    )
    assert [rows(f) for f in found] == [
        [("NarrativeText", "abc")], [("NarrativeText", "shown")], [("Text", "y")], [("Text", "z")], [], [("NarrativeText", "kept")],
        [("Text", "k")], [("NarrativeText", "a")],
    ]


def test_lone_signs(parsed):
    [found] = parsed("a < b <3 > c <= d")
    assert rows(found) == [("Text", "a < b <3 > c <= d")]


def test_all_named_references(spark):
    text = " ".join(f"&{n};" for n in markup.REFERENCES) + " &nosuch; &amp;lt; &#65;&#x42; &#0; & &;"
    row = spark.createDataFrame([(text,)], "t string").select(markup.unescape(F.col("t")).alias("t")).first()
    assert len(markup.REFERENCES) > 2000
    assert row.t == " ".join(stdlib.unescape(f"&{n};") for n in markup.REFERENCES) + " &nosuch; &lt; AB &#0; & &;"


def test_long_pages(parsed):
    cells = "".join(f"<tr><td>{k}</td></tr>" for k in range(3000))
    deep = "<div>" * 600 + "x" + "</div>" * 600
    many = "".join(f"<p>p{k}<b>q</b></p>" for k in range(2000))
    inline = "<p>" + "".join(f"<span a='{k}'>s</span>" for k in range(20_000))
    [table, nested, paragraphs, run, big] = parsed(f"<table>{cells}</table>t", deep, many, inline, "<p>" + "word " * 200_000 + "<img src='" + "x" * 500_000 + "'>")
    assert [r.element_type for r in table] == ["Table", "Text"] and table[0].text.split() == [str(k) for k in range(3000)]
    assert rows(nested) == [("Text", "x")]
    assert [r.text for r in paragraphs] == [f"p{k} q" for k in range(2000)]
    assert len(run) == 1 and run[0].text == " ".join("s" * 20_000)
    assert len(big) == 2 and len(big[1].image_url) == 500_000


def test_no_python_and_no_shuffle(spark):
    raw = spark.createDataFrame([(1, "<p>a</p>")], "doc_id long, html string")
    plan = docs.partition_html(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
