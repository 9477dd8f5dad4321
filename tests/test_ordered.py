"""Running values and segments, with one document as most of the rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.functions.ordered import assemble, last_before, running_sum
from quire.operators import rag
from quire.operators.elements import reindex
from quire.operators.render import render_html, render_markdown, render_text
from quire.operators.render import all_formats
from quire.operators.slides import render_slides
from quire.schema import conform
from quire.sources.documents import fill_parents


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for doc, size in [(1, 300), (2, 7), (3, 1)]:
        for index in sorted(rng.sample(range(size * 3), size)):
            out.append((doc, index, rng.choice([0, 0, 0, 1, 2])))
    return out


@pytest.mark.parametrize("block", [2, 10, 4096])
def test_running_sum(spark, rows, block):
    df = spark.createDataFrame(rows, "doc_id long, element_index int, v int").repartition(5)
    for inclusive in (True, False):
        got = running_sum(df, ["doc_id"], "element_index", F.col("v"), "s", inclusive, block)
        totals, want = {}, {}
        for doc, index, v in rows:
            before = totals.get(doc, 0)
            totals[doc] = before + v
            want[doc, index] = totals[doc] if inclusive else before
        assert {(r.doc_id, r.element_index): r.s for r in got.collect()} == want


@pytest.mark.parametrize("block", [2, 10, 4096])
def test_last_before(spark, rows, block):
    df = spark.createDataFrame(rows, "doc_id long, element_index int, v int").repartition(5)
    value = F.when(F.col("v") == 2, F.col("element_index").cast("string"))
    got = last_before(df, ["doc_id"], "element_index", value, "p", block)
    last, want = {}, {}
    for doc, index, v in rows:
        want[doc, index] = last.get(doc)
        if v == 2:
            last[doc] = str(index)
    assert {(r.doc_id, r.element_index): r.p for r in got.collect()} == want


def test_reindex(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, element_index int, v int")
    got = sorted((r.doc_id, r.element_index) for r in reindex(df).collect())
    assert got == [(d, i) for d, n in [(1, 300), (2, 7), (3, 1)] for i in range(n)]


def elements(spark, n=100):
    kinds = ["Title", "ListItem", "NarrativeText", "PageBreak", "Table", "Image"]
    data = [(1, i, kinds[i % 6], f"text {i}", i // 7 + 1) for i in range(n)] + [(2, 0, "Title", "one", None)]
    return conform(spark.createDataFrame(data, "doc_id long, element_index int, element_type string, text string, page_number int"))


@pytest.mark.parametrize("render, column, sep", [(render_text, "text", "\n\n"), (render_html, "html", "\n"), (render_markdown, "markdown", "\n\n")])
def test_segments_join_to_the_whole(spark, render, column, sep):
    e = elements(spark)
    one = {r.doc_id: r[column] for r in render(e, rows=1000).collect()}
    parts = render(e, rows=9).orderBy("doc_id", "segment").collect()
    assert len(parts) == 13
    for doc in (1, 2):
        assert sep.join(p[column] for p in parts if p.doc_id == doc) == one[doc]


def test_pieces_of_arrays_join_to_json(spark):
    e = elements(spark)
    for make in (lambda n: rag.rag_json_array(rag.rag_documents(e.filter("element_index > 20 OR doc_id = 2")), n), lambda n: all_formats(e, rows=n)):
        one = {r.doc_id: r.json for r in make(1000).collect()}
        parts = make(9).orderBy("doc_id", "segment").collect()
        for doc in (1, 2):
            whole = ",".join(p.json for p in parts if p.doc_id == doc)
            assert whole == one[doc] and isinstance(json.loads(whole), list)


def test_pages_reach_over_segments(spark):
    data = [(1, i, "Text", f"t{i}", None if i % 4 else i // 10 + 1, f"f{i}") for i in range(50)] + [(2, 0, "Title", "one", 1, None)]
    e = conform(spark.createDataFrame(data, "doc_id long, element_index int, element_type string, text string, page_number int, filename string"))
    one = {(r.doc_id, r.page): (r.content, r.element_count) for r in rag.rag_pages(e, 1000).collect()}
    parts = {}
    for r in rag.rag_pages(e, 7).orderBy("segment").collect():
        parts.setdefault((r.doc_id, r.page), []).append(r)
    assert {k: ("\n\n".join(r.content for r in v), sum(r.element_count for r in v)) for k, v in parts.items()} == one


def test_slides_join_to_the_whole(spark):
    data = [(1, i, "Title", f"t{i}", None if i % 3 == 0 else i // 10 + 1) for i in range(60)]
    e = conform(spark.createDataFrame(data, "doc_id long, element_index int, element_type string, text string, page_number int"))
    joined = []
    for rows in (4, 1000):
        parts = render_slides(e, rows=rows, style="<style></style>").orderBy(F.col("slide").asc_nulls_first(), "segment").collect()
        joined.append("\n".join(r.html for r in parts))
    assert joined[0] == joined[1] and joined[0].startswith("<style></style>\n<div")
    assert "style" not in "".join(r.html for r in render_slides(e).collect())


def test_first_footer_of_a_slide_wins(spark):
    e = conform(spark.createDataFrame([(1, 0, "Title", "t", 1)], "doc_id long, element_index int, element_type string, text string, page_number int"))
    footers = spark.createDataFrame([(1, 1, "late", None, None, None, 2), (1, 1, "early", None, None, None, 1)], "doc_id long, slide int, footer_text string, slide_number string, date_text string, notes string, ord int")
    html = [r.html for r in render_slides(e, footers=footers).collect()]
    assert len(html) == 3 and "early" in "".join(html) and "late" not in "".join(html)


def test_assemble_orders_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, None)], "doc_id long, element_index int, p string")
    assert assemble(df, ["doc_id"], "element_index", {"p": "+"}).first().p == "a+c"


def test_rows_without_key_or_position_are_kept(spark):
    df = spark.createDataFrame([(None, 0, 1), (None, 1, 1), (1, None, 1), (1, 3, 1), (1, 4, 1)], "doc_id long, element_index int, v int")
    out = running_sum(df, ["doc_id"], "element_index", F.col("v"), "s", block=2)
    assert sorted(map(str, (tuple(r) for r in out.select("doc_id", "element_index", "s").collect()))) == sorted(
        map(str, [(None, 0, 1), (None, 1, 2), (1, None, 1), (1, 3, 2), (1, 4, 3)])
    )
    last = last_before(df, ["doc_id"], "element_index", F.col("element_index"), "p", block=2)
    assert last.count() == 5 and last.filter("doc_id IS NULL AND p = 0").count() == 1


def test_parents_by_depth_across_blocks(spark):
    # (kind, depth, parent's position)
    rows = [
        ("Text", None, None), ("Title", 0, None), ("Text", None, 1), ("Title", 1, 1), ("Title", 2, 3), ("Text", None, 4), ("Title", 2, 3),
        ("Title", 1, 1), ("Text", None, 7), ("Title", 5, 7), ("Title", 0, None), ("Title", 2, 10), ("Title", None, None), ("Title", 9, 12),
        ("ListItem", 0, 13), ("Title", 7, 12),
    ]
    data = [(d, i, f"{d}-{i}", k, depth) for d in (1, 2) for i, (k, depth, _) in enumerate(rows)]
    e = spark.createDataFrame(data, "doc_id long, element_index int, element_uid string, element_type string, category_depth int")
    for block in (1, 2, 3, 5, 4096):
        found = {(r.doc_id, r.element_index): r.parent_id for r in fill_parents(e, block=block).collect()}
        assert found == {(d, i): p if p is None else f"{d}-{p}" for d in (1, 2) for i, (_, _, p) in enumerate(rows)}
