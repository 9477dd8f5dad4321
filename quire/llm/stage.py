"""Tables in the shared folder that cut the lineage of long jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.session import shared_dir, shuffles_end_with_the_job


def stage(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it again.

    The shuffle files of the write are removed when it has ended, not when the driver
    happens to collect its garbage.
    """
    return write_table(df, shared_dir(df.sparkSession, purpose), compression)


def write_table(df: DataFrame, path: str, compression: str | None = None, mode: str = "error") -> DataFrame:
    """As ``stage``, to a folder of one's own; with mode ``append`` also in several jobs."""
    spark = df.sparkSession
    with shuffles_end_with_the_job(spark):
        df.write.mode(mode).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Remove the folder of a staged table that nothing reads any more."""
    spark = staged.sparkSession
    for file in staged.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
