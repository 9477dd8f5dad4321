"""What the plans must and must not contain."""

import pytest

from quire.operators import elements as el, rag, text as tx
from quire.plans import derived as d
from quire.plans.queries import queries
from quire.session import build_session, shared_dir
from tests.conftest import SMALL

PYTHON_OK = {"chunk_basic", "chunk_by_title", "chunk_counts"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# A user's hook is Python by nature.
@pytest.mark.parametrize("name", sorted(set(queries()) - {"stream_partition", "hook_pictures"}))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(queries()[name](spark, SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text
    if name not in PYTHON_OK:
        assert "InPandas" not in text and "InArrow" not in text


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("e") / "elements")
    d.rich_elements(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


def test_text_queries_do_not_read_payloads(stored):
    for df in (el.text_metrics(stored), tx.contacts(stored), el.type_counts(stored), rag.rag_pages(stored), el.first_elements(stored)):
        assert "image_base64" not in plan(df)


def test_filters_reach_the_scan(stored):
    text = plan(el.first_elements(stored))
    assert "WindowGroupLimit" in text
    assert "In(element_type" in plan(el.image_gallery(stored)) or "element_type IN" in plan(el.image_gallery(stored))


def test_narrow_operators_do_not_shuffle(stored):
    for df in (rag.rag_jsonl(rag.rag_documents(stored)), tx.contacts(stored), tx.clean_text(stored), rag.inline_rag(stored)):
        assert "Exchange" not in plan(df)


def test_preview_limits_before_the_shuffle(stored):
    text = plan(rag.rag_preview(rag.rag_documents(stored)))
    assert text.count("WindowGroupLimit") == 2
    assert text.count("Exchange") == 1


def test_results_do_not_depend_on_partitions(stored):
    one, many = stored.repartition(1), stored.repartition(17)
    for op in (rag.rag_pages, el.text_metrics):
        key = lambda r: str(r)
        assert sorted(op(one).collect(), key=key) == sorted(op(many).collect(), key=key)


def scans(df):
    return plan(df).split("Initial Plan")[0].count("FileScan")


def test_bodies_scan_twice_at_most(stored):
    from quire.operators import render, slides as sl

    for df in (render.render_text(stored), render.render_html(stored), render.render_markdown(stored), render.all_formats(stored),
               rag.rag_json_array(rag.rag_documents(stored)), rag.rag_pages(stored), sl.render_slides(stored)):
        assert scans(df) <= 2
        assert "RoundRobin" not in plan(df)


@pytest.mark.parametrize("made", ["all_formats", "output_files"])
def test_elements_are_shuffled_not_their_forms(stored, made):
    """Every form holds the text again, and some the payload, so none of them is sent."""
    from quire.operators import export, render

    df = render.all_formats(stored, with_images=True) if made == "all_formats" else export.output_files(stored, tuple(export.OUTPUT_SUFFIXES))
    exchanges = [line for line in plan(df).split("Initial Plan")[0].splitlines() if "Exchange " in line]
    assert any("__segment" in x for x in exchanges)
    assert not any(", segment#" in x for x in exchanges)


@pytest.mark.parametrize("extra", [None, "extra"])
def test_json_is_parsed_once(spark, extra):
    """No filter on the parsed object may be pushed below it, where it would be parsed again."""
    from quire.sources.documents import elements_from_json

    rows = spark.createDataFrame([('{"doc_id": 1, "x": 2}',), ("{",), (None,), ('{"text": "a"}',)], "json string").repartition(1)
    out = elements_from_json(rows, extra=extra)
    assert plan(out).split("Initial Plan")[0].count("from_json") == 1
    assert [r.doc_id for r in out.collect()] == [1]


def test_runs_are_counted_before_they_are_buckets(spark):
    from pyspark.sql import functions as F

    from quire.functions import language

    texts = [("en", t) for t in ("a \U0001d400\U0001d401 b\U0001d402", "\U00010330", "x", "", "  ", None, "Ünï ß", "日本 語", "don't\nstop 1a2b")]
    rows = spark.createDataFrame([*texts, (None, "q"), ("xx", "hello there")], "lang string, text string")
    profiles = language.rank_profiles(rows)
    assert "regexp_extract_all" in plan(profiles)
    each = rows.filter("lang IS NOT NULL").select("lang", F.explode(language.runs_of(F.col("text"))).alias("bucket"))
    counts = {}
    for r in each.groupBy("lang", "bucket").count().collect():
        counts.setdefault("eng" if r.lang == "en" else r.lang, []).append((-r["count"], r.bucket))
    want = {(c, b, language.TOP - (k.bit_length() - 1)) for c, v in counts.items() for k, (_, b) in enumerate(sorted(v), 1)}
    assert {tuple(r) for r in profiles.collect()} == want


def test_shared_dir_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    one, two = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert one != two
    assert base is None or one.startswith(base.rstrip("/") + "/")
    assert build_session().conf.get("spark.sql.adaptive.enabled") == "true"


def test_hot_picture_key_is_split(spark):
    """A hash that a third of the rows share is split by adaptive execution."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 40000
        kind = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('h', id % 5000) END"
        rows = spark.range(n, numPartitions=8).selectExpr(
            "id AS doc_id", "int(id) AS element_index", "'Image' AS element_type", f"md5({kind}) AS image_hash", "concat('text ', id) AS content",
            *[f"CAST(NULL AS string) AS {k}" for k in rag.METADATA_KEYS if k not in ("element_index", "element_type", "image_hash")],
        )
        given = spark.range(5000).selectExpr("md5(concat('h', id)) AS image_hash", "'d' AS description", "'m' AS model", "double(0.1) AS cost_estimate")
        out = rag.describe(rows, given)
        assert len(out.collect()) == n
        assert "skew=true" in plan(out)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
