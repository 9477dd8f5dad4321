"""One-pass intake, user hooks, unknown members and language profiles."""

import json
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.functions import language as lg
from quire.plans.derived import PictureHook
from quire.sources import documents as docs, hooks
from quire.sources.intake import intake_rows, read_intake, write_intake
from tests.conftest import SMALL


# --- intake ----------------------------------------------------------------------------


def test_each_row_is_elements_or_a_reason(spark, tmp_path):
    raw = spark.createDataFrame([(1, "s", "a\nb"), (2, "s", None), (3, "s", "")], "doc_id long, source string, text string")
    counts = write_intake(raw, "text", str(tmp_path / "t"))
    assert (counts["elements"], counts["quarantined"], counts["without_text"]) == (3, 1, 1)
    found = read_intake(spark, str(tmp_path / "t"))
    assert sorted((r.doc_id, r.element_index, r.text) for r in found.elements.collect()) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "")]
    assert [(r.doc_id, r.raw_body, r.reason) for r in found.quarantine.collect()] == [(2, None, "no text")]


def test_pages_without_anything_keep_their_body(spark, tmp_path):
    raw = spark.createDataFrame([(1, "u", "<p>a<img src=x></p><table><tr><td>1</table>"), (2, "u", "<div> </div>"), (3, "u", None)], "doc_id long, source string, html string")
    counts = write_intake(raw, "html", str(tmp_path / "h"))
    assert counts == {"elements": 3, "quarantined": 2, "without_text": 1, "tables": 1, "images": 1}
    bad = read_intake(spark, str(tmp_path / "h")).quarantine.orderBy("doc_id").collect()
    assert [(r.doc_id, r.raw_body, r.reason) for r in bad] == [(2, "<div> </div>", "nothing visible"), (3, None, "no html")]
    # The same rows as the separate operators give.
    assert docs.quarantine(raw, "html").count() == 2 and docs.partition_html(raw).count() == 3


def test_json_rows(spark):
    raw = spark.createDataFrame([(1, "a", '{"doc_id":7,"source":"own","text":"x"}'), (2, "b", "{"), (3, "c", None)], "doc_id long, source string, json string")
    rows = {r.kind + str(r.doc_id): r for r in intake_rows(raw, "json").collect()}
    assert rows["element7"].source == "own" and rows["quarantine2"].raw_body == "{" and rows["quarantine3"].reason == "no json"


def test_one_scan_and_no_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "s", "<p>a")], "doc_id long, source string, html string").write.parquet(str(tmp_path / "r"))
    plan = intake_rows(spark.read.parquet(str(tmp_path / "r")), "html")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan
    with pytest.raises(ValueError):
        intake_rows(spark.range(1), "pdf")


# --- hooks -----------------------------------------------------------------------------


class Words:
    def iter_elements(self, row):
        for word in (row["text"] or "").split():
            if word == "boom":
                raise RuntimeError("no")
            yield {"text": word, "element_type": "Text", "links": [{"url": word, "text": None}]}


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([(1, "a b"), (2, None), (3, "x boom"), (4, "z")], "doc_id long, text string")


def test_a_hook_yields_none_to_many(spark, raw):
    hooks.register_hook(spark, "words_hook", Words, ("text",))
    rows = hooks.apply_hook(raw, "words_hook", ("text",)).collect()
    assert sorted((r.doc_id, r.element_index, r.text) for r in rows if r.hook_error is None) == [(1, 0, "a"), (1, 1, "b"), (4, 0, "z")]
    assert [(r.doc_id, r.hook_error) for r in rows if r.hook_error] == [(3, "RuntimeError: no")]
    assert all(r.links[0].url == r.text for r in rows if r.hook_error is None)


def test_a_hook_takes_whole_batches(spark):
    """One Arrow table a batch, also where elements are many more than rows, with all kinds of columns."""

    class Many:
        def iter_elements(self, row):
            for k in range(row["n"] or 0):
                yield {"text": f"{row['n']} {k}", "page_number": k, "regex_metadata": {"a": "b"} if k else None, "languages": ["de"]}

    raw = spark.range(700, numPartitions=2).selectExpr("id AS doc_id", "int(id % 3) AS n").unionByName(spark.createDataFrame([(None, 2), (8, None)], "doc_id long, n int"))
    hooks.register_hook(spark, "many_hook", Many, ("n",))
    out = hooks.apply_hook(raw, "MANY_hook", ("n",))
    assert "ArrowEvalPythonUDTF" not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted((str(r.doc_id), k, f"{r.n} {k}") for r in raw.collect() for k in range(r.n or 0))
    rows = out.collect()
    assert sorted((str(r.doc_id), r.element_index, r.text) for r in rows) == want
    assert all(r.languages == ["de"] and r.regex_metadata == ({"a": "b"} if r.page_number else None) for r in rows)
    raw.createOrReplaceTempView("many_rows")
    by_sql = spark.sql(f"SELECT r.doc_id, {', '.join(f'h.`{c}`' for c in hooks.FIELDS)}, h.hook_error FROM many_rows r, LATERAL many_hook(r.n) h WHERE r.doc_id < 30")
    assert by_sql.schema.simpleString() == out.schema.simpleString()
    assert sorted(map(str, by_sql.collect())) == sorted(str(r) for r in rows if r.doc_id is not None and r.doc_id < 30)


def test_a_hook_in_sql_and_registered_again(spark, raw):
    hooks.register_hook(spark, "words_hook", Words, ("text",))
    hooks.register_hook(spark, "words_hook", Words, ("text",))
    raw.createOrReplaceTempView("raw_rows")
    found = spark.sql("SELECT r.doc_id, count(*) AS n FROM raw_rows r, LATERAL words_hook(r.text) h WHERE h.hook_error IS NULL GROUP BY 1").collect()
    assert {(r.doc_id, r.n) for r in found} == {(1, 2), (4, 1)}


def test_fields_a_hook_cannot_set(spark, raw):
    class Wrong:
        def iter_elements(self, row):
            yield {"doc_id": 9, "text": "x"}

    hooks.register_hook(spark, "wrong_hook", Wrong, ("text",))
    assert {r.hook_error for r in hooks.apply_hook(raw, "wrong_hook", ("text",)).collect()} == {"ValueError: unknown fields: doc_id"}
    with pytest.raises(ValueError):
        hooks.register_hook(spark, "bad name", Words, ("text",))
    with pytest.raises(TypeError):
        hooks.register_hook(spark, "no_hook", dict, ("text",))


def test_hooks_need_no_package(tmp_path):
    class Own:
        def iter_elements(self, row):
            yield {"text": row["text"]}

    (tmp_path / "f").write_bytes(cloudpickle.dumps(hooks._table_function(Own, ("text",), ("element_index", "text"))))
    code = "import pickle; print(list(pickle.load(open('f', 'rb'))().eval('a')))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "[(0, 'a', None)]", done.stderr


def test_the_picture_hook():
    rows = [{"element_index": 1, "page_number": None, "name": None, "blob": b"x", "content_type": None, "ext": "PNG"}, {"blob": None}, {"blob": b""}]
    found = [list(PictureHook().iter_elements(r)) for r in rows]
    assert found[0][0]["image_mime_type"] == "image/png" and found[0][0]["page_number"] == 1 and found[1:] == [[], []]


# --- unknown members -------------------------------------------------------------------


def test_unknown_members_come_back(spark):
    members = {"x": {"b": [1, None, {"c": "é"}], "a": 1.25}, "it's": "q\"uote", "flag": False, "none": None, "big": 12345678901234567890, "": 1}
    known = {"doc_id": 1, "element_index": 0, "text": "t", "languages": ["deu"]}
    rows = spark.createDataFrame([(json.dumps(known | members, ensure_ascii=False),), (json.dumps(known),), ("{",), ('{"x":1}',)], "json string")
    once = docs.elements_from_json(rows, extra="extra").withColumn("json", docs.elements_to_json("extra"))
    texts = sorted((r.json for r in once.collect()), key=len)
    assert len(texts) == 2 and json.loads(texts[0]) == known
    back = json.loads(texts[1])
    assert {k: back[k] for k in members} == members and {k: back[k] for k in known} == known
    again = docs.elements_from_json(once.select("json"), extra="extra").select(docs.elements_to_json("extra").alias("json"))
    assert sorted((r.json for r in again.collect()), key=len) == texts
    plain = docs.elements_from_json(rows)
    assert "extra" not in plain.columns and plain.count() == 2


# --- languages -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def profiles(labelled):
    return lg.train_profiles(labelled.filter("doc_id % 2 = 0"))


def test_held_out_documents_and_lines(labelled, profiles):
    away = labelled.filter("doc_id % 2 = 1")
    lines = away.select("lang", F.explode(F.split("text", "\n")).alias("text")).filter("length(text) > 20")
    for table, least in ((away, 0.99), (lines, 0.97)):
        rows = table.select("lang", lg.first_code(lg.languages_of(F.col("text"), profiles)).alias("found")).collect()
        assert sum(lg.CODES[r.lang] == r.found for r in rows) >= least * len(rows)


def test_probabilities_of_an_element(labelled, profiles, make):
    texts = {r.lang: r.text for r in labelled.filter("length(text) > 400").orderBy("doc_id").collect()}
    mixed = texts["de"][:60] + " " + texts["fr"][:60]
    e = make({"text": texts["es"]}, {"text": None}, {"text": " 12 --- "}, {"text": "x"}, {"text": mixed}, {"text": texts["en"] * 50})
    rows = docs.detect_languages(e, profiles=profiles).orderBy("element_index").collect()
    assert rows[0].languages == ["spa"] and rows[0].language_probabilities[0] > 0.99
    assert [rows[k].language for k in (1, 2)] == ["und", "und"] and [rows[k].languages for k in (1, 2)] == [[], []]
    for r in rows:
        p = r.language_probabilities
        assert p == sorted(p, reverse=True) and sum(p) <= 1 + 1e-9 and all(x >= lg.SHARE for x in p[1:])
    assert set(rows[4].languages) <= {"deu", "fra"} and rows[5].languages == ["eng"]


def test_scores_equal_plain_sums(spark, profiles):
    texts = ["Das ist ein Satz, der nicht so kurz ist.", "", None, "a", "Ünï çé 12 x", "wort " * 5000]
    ranked = {(r["code"], r["bucket"]): r["score"] for r in lg.rank_profiles(spark.createDataFrame([(t, "de") for t in texts], "text string, lang string")).collect()}
    own = lg.train_profiles(spark.createDataFrame([(t, "de") for t in texts], "text string, lang string"))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    found = {r.k: (r.s, r.r) for r in rows.select("k", lg.scores_of(F.col("text"), own).alias("s"), lg.runs_of(F.col("text")).alias("r")).collect()}
    for scores, runs in found.values():
        assert scores == [sum(ranked.get(("deu", b), 0) for b in runs)]
    letters = " das ist ein satz der nicht so kurz ist "
    want = [(ord(letters[i]) * 1369 + ord(letters[i + 1]) * 37 + ord(letters[i + 2])) % lg.BUCKETS for i in range(len(letters) - 2)]
    assert found[0][1] == want and found[1][1] == found[2][1] == []


def test_more_than_four_languages(spark):
    words = {"de": "und der die", "en": "the and of", "fr": "les des une", "es": "los que para", "it": "della gli che", "xx": "zzq qqz zqz"}
    own = lg.train_profiles(spark.createDataFrame([(w * 5, c) for c, w in words.items()], "text string, lang string"))
    assert own.codes == tuple(sorted(lg.known_codes(list(words)))) and len(own.tables) == 2
    rows = spark.createDataFrame(list(words.items()), "lang string, text string")
    assert all(r.c == lg.CODES.get(r.lang, r.lang) for r in rows.select("lang", lg.first_code(lg.languages_of(F.col("text"), own)).alias("c")).collect())
    nothing = lg.Profiles((), ())
    assert spark.range(1).select(lg.languages_of(F.lit("a"), nothing).alias("l")).first().l == []


def test_profiles_run_inside_the_jvm(spark, profiles, make):
    plan = docs.detect_languages(make({"text": "a"}), profiles=profiles)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
