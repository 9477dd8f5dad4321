"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import cross_entropy, language, quality, tokens
from quire.llm.decontaminate import contamination, decontaminate
from quire.llm.exact_dup import drop_exact_duplicates, exact_duplicates
from quire.llm.licenses import scan_licenses
from quire.llm.mixing import mix, plan_mix
from quire.llm.near_dup import drop_near_duplicates, near_duplicates
from quire.llm.sharding import shard_rows
from tests.llm.conftest import EDGES, EXTRA


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality(spark, edges, none):
    labels = spark.createDataFrame([(4, 1), (5, 1), (9, 0), (None, 1), (6, None), (1, 0)], "doc_id long, label int")
    weights = quality.train(edges, labels)
    scored = quality.score(edges, weights)
    assert scored.count() == len(EDGES) and scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    rows = by_id(scored)
    assert rows[1]["score"] == rows[2]["score"] == rows[3]["score"]
    assert rows[4]["score"] > rows[9]["score"]
    empty = quality.train(none, labels)
    assert not empty.any() and quality.score(none, empty).count() == 0
    assert {r["score"] for r in quality.score(edges, empty).collect()} == {0.5}


def test_token_output(edges, none):
    packed = tokens.training_order(edges, length=8, records=4).collect()
    assert sorted(r["slot"] for r in packed) == list(range(len(packed)))
    assert all(r["slot"] == r["shard"] * 4 + r["record"] and len(r["tokens"]) == 16 for r in packed)
    assert tokens.training_order(none).count() == 0
    assert tokens.training_order(edges.filter("doc_id <= 2")).count() == 0


def test_near_duplicates(edges, none):
    found = near_duplicates(edges)
    assert found.count() == len(EDGES)
    rows = by_id(found)
    assert [(rows[k]["n_shingles"], rows[k]["component_id"]) for k in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert rows[5]["component_id"] == 4 and not rows[5]["kept"] and rows[5]["n_shingles"] == 5
    assert rows[6]["n_shingles"] == 1 and rows[6]["kept"]
    assert rows[8]["component_id"] == 7 and rows[7]["n_shingles"] == 2
    assert rows[None]["component_id"] is None and rows[None]["kept"]
    assert near_duplicates(none).count() == 0
    kept = drop_near_duplicates(edges)
    assert kept.columns == edges.columns and kept.count() == len(EDGES) - 2


def test_exact_duplicates(edges, none):
    found = exact_duplicates(edges)
    assert found.count() == len(EDGES)
    rows = by_id(found)
    # White space counts for the longest text only.
    assert rows[1]["keep_id"] == rows[2]["keep_id"] == 3 and rows[3]["group_size"] == 3
    assert rows[6]["group_size"] == 2 and rows[6]["kept"]
    assert rows[8]["keep_id"] == 7 and rows[4]["keep_id"] == 4 and rows[5]["keep_id"] == 5
    assert rows[None]["keep_id"] is None and rows[None]["kept"]
    assert exact_duplicates(none).count() == 0
    assert drop_exact_duplicates(edges).columns == edges.columns


def test_exact_duplicates_compare_bytes(frame):
    docs = frame("a b", "ab", "cd", "c d", "ef", None, "gh")
    weak = exact_duplicates(docs, content_hash=lambda text: F.length(text) % 2)
    strong = exact_duplicates(docs)
    assert sorted(map(tuple, weak.collect()), key=str) == sorted(map(tuple, strong.collect()), key=str)


def test_decontamination(spark, edges, none):
    items = [("a", "quick brown fox jumps over the LAZY dog"), ("b", "one"), (None, "café"), ("c", None), ("d", ""), ("b", "two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (500_000, 2):  # in one block and in several
        rows = {r["row"]["doc_id"]: r for r in contamination(edges, bench, [F.col("doc_id")], block).collect()}
        assert [rows[k]["n_hit"] for k in (1, 2, 3, 4, 5, 6, 7, 10)] == [0, 0, 0, 8, 8, 2, 0, 1]
        assert rows[4]["items"] == ["a"] and rows[6]["items"] == ["b"] and rows[10]["items"] == []
    assert decontaminate(none, bench).count() == 0
    clean = decontaminate(edges, bench)
    assert clean.columns == edges.columns and clean.count() == len(EDGES) - 5
    cut = by_id(decontaminate(edges, bench, "spans"))
    assert cut[4]["text"] == "The " and cut[4]["n_chars"] == 4 and cut[1]["text"] is None and cut[1]["n_chars"] is None
    assert cut[10]["text"].endswith("naïve ") and cut[4]["row"] == "own row"
    empty = bench.filter("1 = 0")
    assert decontaminate(edges, empty).count() == len(EDGES)


def test_language(edges, none):
    keep = [F.col("doc_id")]
    model = language.train(edges)
    rows = {r["row"]["doc_id"]: r for r in language.identify(edges, model, keep).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 3, 9)] == ["und"] * 4
    assert rows[4]["lang_pred"] in ("de", "en") and 0 < rows[4]["score"] <= 1
    assert language.train(none) is None and language.identify(none, model, keep).count() == 0
    assert {r["lang_pred"] for r in language.identify(edges, None, keep).collect()} == {"und"}
    kept = language.relabel(edges, model)
    assert kept.columns == edges.columns and kept.count() == len(EDGES) - 4


def test_cross_entropy(edges, none):
    marked = edges.drop("target").withColumn("target", F.col("doc_id") < 6)
    model = cross_entropy.train(marked)
    scored = cross_entropy.score(edges, model)
    rows = by_id(scored)
    assert scored.count() == len(EDGES) and rows[1]["n_tokens"] == 0 and rows[1]["difference"] is None
    assert rows[7]["n_tokens"] == 60_001 and rows[4]["difference"] < rows[7]["difference"]
    blank = cross_entropy.train(none.drop("target").withColumn("target", F.lit(None).cast("boolean")))
    assert cross_entropy.score(none, blank).count() == 0
    assert by_id(cross_entropy.score(edges, blank))[4]["difference"] == 0


def test_licenses(edges, none):
    rows = by_id(scan_licenses(edges))
    assert scan_licenses(edges).count() == len(EDGES)
    assert (rows[1]["n_words"], rows[1]["n_base"], rows[1]["first_word"], rows[1]["labels"], rows[1]["score"]) == (0, 0, None, "", 0)
    assert rows[7]["n_words"] == 60_001
    assert scan_licenses(none).count() == 0


def test_mixing(edges, none):
    plan = plan_mix(edges, [F.col("doc_id"), F.col("source")], block_words=2, bin_rows=3)
    rows = plan.collect()
    assert len(rows) == len(EDGES) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["target"] for r in {r["row"]["source"]: r for r in rows}.values()) > 0
    assert plan_mix(none, [F.col("doc_id")]).count() == 0
    mixed = mix(edges, block_words=2, bin_rows=3)
    assert mixed.columns == edges.columns
    words = mixed.select(F.sum(F.size(F.expr(r"regexp_extract_all(text, '([^ \\t\\n]+)')")))).first()[0]
    assert words == sum(r["taken"] for r in rows)


def test_sharding(edges, none):
    rows = shard_rows(edges, group_rows=1).collect()
    assert len(rows) == len(EDGES)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert [r["size"] for r in rows if r["doc_id"] == 1] == [16] and [r["text_crc32"] for r in rows if r["doc_id"] == 1] == [0]
    assert shard_rows(none).count() == 0


def test_pipeline_stages(spark, edges, none, tmp_path):
    spark.createDataFrame([("i", "one two")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (edges, none):
        docs = start
        for name, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, str(tmp_path))
            if name != "token_output":
                assert docs.columns == start.columns
        docs.count()
    assert len(EXTRA) == len(set(EXTRA))
