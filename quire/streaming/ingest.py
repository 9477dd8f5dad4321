"""New documents turned into elements as they arrive."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from quire.session import shared_dir
from quire.sources.documents import partition_text

RAW_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def document_stream(
    spark: SparkSession,
    path: str,
    pattern: str = "*.parquet",
    schema: str | T.StructType = RAW_SCHEMA,
    files_per_batch: int = 1000,
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def write_elements(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Partition each document of the stream and append its elements to a Parquet table.

    The work is stateless, so a lost executor only repeats its files; offsets and the
    table's commit log live in shared folders.
    """
    return (
        partition_text(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _is_file(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()


def ingest_available(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Process what is there now and return the written elements.

    ``path`` is a folder, of which the files named by ``pattern`` are taken, or one file.
    A folder without documents gives no elements.
    """
    if _is_file(spark, path):
        path, _, name = path.rpartition("/")
        pattern = re.sub(r"([\\*?\[\]{}])", r"\\\1", name)
    base = shared_dir(spark, "ingest")
    stream = document_stream(spark, path, pattern)
    write_elements(stream, f"{base}/elements", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(partition_text(stream).schema).parquet(f"{base}/elements")
