"""Uploads that replace earlier ones: the latest version of each document, once.

A folder holds two Parquet tables, both written in one folder for each batch of the
stream.  ``elements`` has what a batch's documents were partitioned into, ``uploads`` is
the ledger: which documents a batch brought or deleted, and with which upload number.  The
ledger of a batch is written after its elements, so a batch without one does not count; a
batch that is played again finds its ledger and does nothing, or, if it was lost before,
writes the same folders anew.  Reading takes the elements of each document's latest
upload, whichever batch it came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.joins import one_per_key
from quire.sources.documents import partition_text

LEDGER_SCHEMA = "doc_id bigint, upload bigint, deleted boolean, batch bigint"


def _uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{path}/uploads")


def _is_done(spark: SparkSession, path: str, batch: int) -> bool:
    """Whether the ledger of a batch was completed."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/uploads/batch={batch}/_SUCCESS")
    return files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)


def _latest(order: Column) -> Column:
    """The newest upload of a document; of equal numbers, a deletion, then the greater text."""
    return F.max_by(F.struct("upload", "deleted", "text", "rest"), order)


def merge_batch(batch: DataFrame, number: int, path: str) -> None:
    """Write a batch of uploads (doc_id, upload, text, ...); a null text deletes a document.

    If a batch has several uploads of a document, the one with the highest number counts.
    """
    spark = batch.sparkSession
    if _is_done(spark, path, number):
        return
    rest = [c for c in batch.columns if c not in ("doc_id", "upload", "text")]
    rows = batch.select("doc_id", F.col("upload").cast("long").alias("upload"), F.col("text").isNull().alias("deleted"), "text", F.struct(F.lit(True).alias("__any"), *rest).alias("rest"))
    newest = rows.groupBy("doc_id").agg(_latest(F.struct("upload", "deleted", F.coalesce("text", F.lit("")))).alias("u"))
    kept = newest.select("doc_id", "u.upload", "u.deleted", "u.text", *[F.col(f"u.rest.`{c}`").alias(c) for c in rest])
    partitioned = partition_text(kept.filter(~F.col("deleted")).drop("deleted"))
    partitioned.write.mode("overwrite").parquet(f"{path}/elements/batch={number}")
    kept.select("doc_id", "upload", "deleted").write.mode("overwrite").parquet(f"{path}/uploads/batch={number}")


def replace_elements(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch of a stream of uploads into the tables below ``path``."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of each document's latest upload; deleted documents have none.

    Of equal upload numbers the later batch counts.  The ledger is one narrow row for each
    upload; a document with very many elements is split over the join's tasks.
    """
    version = F.struct("upload", "batch", "deleted")
    latest = one_per_key(_uploads(spark, path), ["doc_id"], F.max(version).alias("v"))
    live = latest.filter("NOT v.deleted").select("doc_id", F.col("v.batch").alias("batch"))
    return spark.read.parquet(f"{path}/elements").join(live, ["doc_id", "batch"]).drop("batch", "upload")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The current state as the first batch of a new folder, without replaced versions."""
    version = F.struct("upload", "batch", "deleted")
    latest = _uploads(spark, path).groupBy("doc_id").agg(F.max(version).alias("v"))
    ledger = latest.select("doc_id", "v.upload", "v.deleted", "v.batch")
    live = spark.read.parquet(f"{path}/elements").join(ledger.filter("NOT deleted").select("doc_id", "batch"), ["doc_id", "batch"])
    live.drop("batch").write.parquet(f"{to}/elements/batch=0")
    ledger.select("doc_id", "upload", "deleted").write.parquet(f"{to}/uploads/batch=0")
