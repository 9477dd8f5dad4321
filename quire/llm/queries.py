"""Named queries of the training-data operators, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.joins import in_lookup
from quire.llm import cross_entropy, language, quality, rules
from quire.llm.conversations import damage, repair_audit
from quire.llm.decontaminate import contamination
from quire.llm.divergence import source_divergence
from quire.llm.exact_dup import exact_duplicates
from quire.llm.licenses import scan_licenses
from quire.llm.mixing import plan_mix
from quire.llm.near_dup import near_duplicates
from quire.llm.sharding import shard_rows
from quire.llm.tokens import written_order

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_quality(spark, sf):
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    learned = labels.filter(quality.text_fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.train(docs, learned))
    held_out = F.coalesce(quality.text_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op2_training_order(spark, sf):
    return written_order(_table(spark, sf, "documents"))


@query
def op3_near_duplicates(spark, sf):
    return near_duplicates(_table(spark, sf, "documents"))


@query
def op4_exact_duplicates(spark, sf):
    return exact_duplicates(_table(spark, sf, "documents"))


@query
def op5_decontamination(spark, sf):
    found = contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), [F.col("doc_id")])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op6_language(spark, sf):
    docs = _table(spark, sf, "documents")
    fold = quality.text_fold(F.col("doc_id"), 4)
    model = language.train(docs.filter(fold != 2))
    scored = language.identify(docs, model, [F.col("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out")])
    return scored.select("row.doc_id", "row.held_out", "lang_pred", "score")


@query
def op7_cross_entropy(spark, sf):
    """The target are the documents that ``labels`` marks as good and not toxic."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    good = _table(spark, sf, "labels").filter("quality = 1 AND toxic = 0")
    return cross_entropy.score(docs, cross_entropy.train(in_lookup(docs, good, "doc_id", "target")))


@query
def op8_licenses(spark, sf):
    return scan_licenses(_table(spark, sf, "documents"))


@query
def op9_mixing(spark, sf):
    plan = plan_mix(_table(spark, sf, "documents"), [F.col("doc_id")])
    return plan.select("row.doc_id", "size", "source_size", "target", "taken")


@query
def op10_sharding(spark, sf):
    return shard_rows(_table(spark, sf, "documents"))


@query
def op11_quality_rules(spark, sf):
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    judged = rules.judge(docs, rules.train(docs, labels.select("doc_id", F.col("quality").alias("label"))))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", "probability", "review")


@query
def op12_conversation_repair(spark, sf):
    audits = repair_audit(damage(_table(spark, sf, "conversations")))
    return audits.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@query
def op13_source_divergence(spark, sf):
    return source_divergence(_table(spark, sf, "documents"))
