"""Uploads that replace: changed, deleted, late and repeated ones, batches played again."""

import pytest

from quire.streaming import replace
from quire.streaming.ingest import document_stream
from quire.streaming.replace import compact, current_elements, merge_batch, replace_elements

SCHEMA = "doc_id long, upload long, source string, text string"


@pytest.fixture
def state(spark, tmp_path):
    def at(path=tmp_path / "t"):
        rows = current_elements(spark, str(path)).collect()
        out = {}
        for r in sorted(rows, key=lambda r: r.element_index):
            out.setdefault(r.doc_id, []).append(r.text)
        return out

    def merge(number, *rows, path=tmp_path / "t"):
        merge_batch(spark.createDataFrame(rows, SCHEMA), number, str(path))

    return at, merge


def test_a_second_upload_replaces_the_first(state):
    at, merge = state
    merge(0, (1, 1, "s", "a\nb\nc"), (2, 1, "s", "x"), (3, 1, "s", "y"))
    merge(1, (1, 2, "s", "new"), (3, 2, "s", None))
    assert at() == {1: ["new"], 2: ["x"]}
    merge(2, (3, 3, "s", "back"))
    assert at() == {1: ["new"], 2: ["x"], 3: ["back"]}


def test_late_and_repeated_uploads(state):
    at, merge = state
    merge(0, (1, 5, "s", "five"), (1, 4, "s", "four"), (1, 5, "s", "five"))
    merge(1, (1, 3, "s", "three"), (2, 1, "s", None))
    assert at() == {1: ["five"]}
    merge(2, (1, 5, "s", "five again"))
    assert at() == {1: ["five again"]}
    # Of a deletion and a text with one number in one batch the deletion counts.
    merge(3, (1, 6, "s", "six"), (1, 6, "s", None))
    assert at() == {}


def test_a_batch_played_again_changes_nothing(state, spark, tmp_path):
    at, merge = state
    merge(0, (1, 1, "s", "a"))
    merge(1, (1, 2, "s", "b"))
    merge(0, (1, 9, "s", "other"))
    assert at() == {1: ["b"]}


def test_a_batch_that_broke_off_is_written_anew(state, monkeypatch):
    at, merge = state
    merge(0, (1, 1, "s", "a"), (2, 1, "s", "x"))

    class Broken(Exception):
        pass

    real = replace.partition_text

    def fails(df):
        real(df).write.mode("overwrite").parquet(str(fails.path))
        raise Broken

    import tempfile

    fails.path = tempfile.mkdtemp() + "/e"
    with monkeypatch.context() as m:
        m.setattr(replace, "partition_text", fails)
        with pytest.raises(Broken):
            merge(1, (1, 2, "s", "b"))
    assert at() == {1: ["a"], 2: ["x"]}
    merge(1, (1, 2, "s", "b"))
    assert at() == {1: ["b"], 2: ["x"]}


def test_elements_without_a_ledger_do_not_count(state, tmp_path):
    import shutil

    at, merge = state
    merge(0, (1, 1, "s", "a"))
    merge(1, (1, 2, "s", "b"))
    shutil.move(tmp_path / "t/uploads/batch=1", tmp_path / "gone")
    assert at() == {1: ["a"]}
    merge(1, (1, 2, "s", "b"))
    assert at() == {1: ["b"]}


def test_compacting_keeps_the_state(state, spark, tmp_path):
    at, merge = state
    merge(0, (1, 1, "s", "a\nb"), (2, 1, "s", "x"), (3, 1, "s", "y"))
    merge(1, (1, 2, "s", "c"), (2, 2, "s", None))
    compact(spark, str(tmp_path / "t"), str(tmp_path / "u"))
    assert at(tmp_path / "u") == at() == {1: ["c"], 3: ["y"]}
    # The deletion is remembered: an older upload does not bring the document back.
    merge(7, (2, 1, "s", "x"), path=tmp_path / "u")
    assert at(tmp_path / "u") == {1: ["c"], 3: ["y"]}


def test_a_stream_of_files(spark, tmp_path, state):
    at, _ = state
    for k, rows in enumerate([[(1, 1, "s", "a"), (2, 1, "s", "x")], [(1, 2, "s", "b\nc")], [(2, 2, "s", None), (3, 2, "s", "z")]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}.parquet"))
        stream = document_stream(spark, str(tmp_path / "in/*"), schema=SCHEMA, files_per_batch=1)
        replace_elements(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert at() == {1: ["b", "c"], 3: ["z"]}
