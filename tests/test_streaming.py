"""The stream takes each file once and equals the batch result."""

from quire.plans.queries import queries
from quire.sources.documents import partition_text
from quire.sources.files import list_files
from quire.streaming.ingest import RAW_SCHEMA, document_stream, write_elements


def drop_file(spark, folder, name, rows):
    spark.createDataFrame(rows, RAW_SCHEMA).coalesce(1).write.parquet(str(folder / name))


def test_new_files_only(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    for name, rows in (("a", [(1, "x\ny", "en", "s", 3)]), ("b", [(2, "z", "en", "s", 1)])):
        drop_file(spark, source, name, rows)
        stream = document_stream(spark, str(source / "*"))
        write_elements(stream, out, checkpoint).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 3
    batch = partition_text(spark.read.schema(RAW_SCHEMA).parquet(str(source / "*")))
    assert got.select(*batch.columns).exceptAll(batch).count() == 0
    write_elements(document_stream(spark, str(source / "*")), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_a_table_of_several_files(spark, tmp_path):
    rows = [(k, f"a{k}\nb", "en", "s", 4) for k in range(9)] + [(None, None, None, None, None)]
    for kind, parts in (("folder", 3), ("none", 0)):
        table = spark.createDataFrame(rows[: parts * 9], RAW_SCHEMA)
        table.repartition(max(parts, 1)).write.parquet(str(tmp_path / kind / "documents.parquet"))
        got = queries()["stream_partition"](spark, str(tmp_path / kind))
        assert sorted((r.doc_id, r.element_index, r.text) for r in got.collect()) == [
            (k, i, t) for k, text, *_ in rows[: parts * 9] if text for i, t in enumerate(text.split("\n"))
        ]


def test_a_table_of_one_file(spark, tmp_path):
    spark.createDataFrame([(1, "x\ny", "en", "s", 3)], RAW_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "t"))
    for name in ("documents.parquet", "other.parquet"):
        next((tmp_path / "t").glob("part-*")).with_name(name).write_bytes(next((tmp_path / "t").glob("part-*")).read_bytes())
    assert queries()["stream_partition"](spark, str(tmp_path / "t")).count() == 2


def test_files_are_listed_without_content(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.pdf").write_text("x")
    files = list_files(spark, str(tmp_path), "*.txt")
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in files.collect()] == [("a.txt", 5)]
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
