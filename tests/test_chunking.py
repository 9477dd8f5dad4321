"""Chunk packing against a plain loop, with documents of many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators.chunking import chunk_counts, chunk_elements, split_oversized


def loop(items, maximum, soft, overlap, by_title):
    """Packing as defined: pieces in order, each into the open chunk if it may go there."""
    step = maximum - overlap
    chunks, section = [], 0
    for index, kind, text in items:
        if not text.strip():
            continue
        title = by_title and kind == "Title"
        section += title
        n = len(text)
        pieces = [text] if n <= maximum else [text[k * step : k * step + maximum] for k in range(-(-(n - overlap) // step))]
        for k, piece in enumerate(pieces):
            last = chunks[-1] if chunks else None
            size = len("\n\n".join(last["texts"])) if last else 0
            if last is None or (title and k == 0) or size >= soft or size + 2 + len(piece) > maximum:
                chunks.append({"texts": [], "orig": [], "section": section})
            chunks[-1]["texts"].append(piece)
            chunks[-1]["orig"].append((index, k))
    return [(i, c["section"], "\n\n".join(c["texts"]), c["orig"]) for i, c in enumerate(chunks)]


def documents(seed, docs, length, maximum):
    rng = random.Random(seed)
    rows = []
    for doc in range(docs):
        # The first document is most of the rows.
        for index in range(length * 12 if doc == 0 else rng.randint(1, length)):
            size = rng.choice([0, 1, 3, 8, 15, maximum - 2, maximum, maximum + 1, 3 * maximum])
            text = "".join(rng.choice("abcdé 🙂") for _ in range(size))
            rows.append((doc, index, rng.choice(["Title", "ListItem", "NarrativeText", "Text"]), text))
    return rows


@pytest.mark.parametrize("strategy", ["basic", "by_title"])
@pytest.mark.parametrize("block", [3, 16, 1024])
def test_packing_equals_loop(spark, strategy, block):
    maximum, soft, overlap = 40, 25, 7
    rows = documents(block, 6, 30, maximum)
    df = spark.createDataFrame(rows, "doc_id long, element_index int, element_type string, text string").repartition(7)
    got = chunk_elements(df, strategy, maximum, soft, overlap, block)
    result = {}
    for r in got.collect():
        result.setdefault(r.doc_id, []).append(
            (r.chunk_index, r.section, r.text, [(o.element_index, o.piece) for o in r.orig])
        )
    for doc in {r[0] for r in rows}:
        items = [(i, k, t) for d, i, k, t in rows if d == doc]
        want = loop(items, maximum, soft, overlap, strategy == "by_title")
        assert sorted(result.get(doc, [])) == want
    counts = {r.doc_id: r.chunk_count for r in chunk_counts(df, strategy, maximum, soft, overlap, block).collect()}
    assert counts == {doc: len(chunks) for doc, chunks in result.items()}


def test_counts_move_no_texts(spark):
    df = spark.createDataFrame([(1, 0, "Title", "a")], "doc_id long, element_index int, element_type string, text string")
    plan = chunk_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line for line in plan.splitlines() if "Exchange" in line or "collect_list" in line)


def test_soft_and_hard_limits(spark):
    def sizes(*lengths):
        rows = [(1, i, "Text", "x" * n) for i, n in enumerate(lengths)]
        df = spark.createDataFrame(rows, "doc_id long, element_index int, element_type string, text string")
        return [len(r.text) for r in chunk_elements(df).orderBy("chunk_index").collect()]

    assert sizes(2000) == [1000, 1000, 100]
    assert sizes(800, 10) == [800, 10]
    assert sizes(790, 208) == [1000]
    assert sizes(790, 209) == [790, 209]


def test_pieces_restore_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(12345)) + "é🙂"
    df = spark.createDataFrame([(1, 0, "Text", text)], "doc_id long, element_index int, element_type string, text string")
    rows = split_oversized(df).orderBy("piece").collect()
    assert max(len(r.piece_text) for r in rows) <= 1000
    assert rows[0].piece_text + "".join(r.piece_text[50:] for r in rows[1:]) == text


def test_unknown_strategy_is_basic(spark):
    rows = [(1, 0, "Title", "a"), (1, 1, "Title", "b")]
    df = spark.createDataFrame(rows, "doc_id long, element_index int, element_type string, text string")
    assert chunk_elements(df, "other").count() == 1
    assert chunk_elements(df, "by_title").count() == 2


def test_bad_limits(spark):
    df = spark.createDataFrame([(1, 0, "Title", "a")], "doc_id long, element_index int, element_type string, text string")
    with pytest.raises(ValueError):
        chunk_elements(df, overlap=600)
    with pytest.raises(ValueError):
        chunk_elements(df, new_after_n_chars=0)
    assert df.select(F.count("*")).first()[0] == 1


def test_task_functions_need_no_package(tmp_path):
    """Executors unpickle the task functions without this package on their path."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from quire.operators.chunking import _block_runs, _carry

    (tmp_path / "f").write_bytes(cloudpickle.dumps((_block_runs(40, 25, 7), _carry())))
    code = (
        "import pickle, pandas as pd; runs, carry = pickle.load(open('f', 'rb'));"
        "b = pd.DataFrame({'doc_id': [1], 'block': [1], 'lengths': [[5, 50]], 'forced': [[False, False]]});"
        "out = pd.concat(runs([b])); print(len(pd.concat(carry([out]))))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "1", done.stderr
