"""Quality rules against plain counting, a plain classifier and held-out rows."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import rules
from quire.llm.queries import queries
from tests.conftest import SMALL
from tests.llm.conftest import EDGES


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    hit = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(hit)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["a", "B", "b", "ß", "#tag", "x|y", "字", " ", "end.", "<b>"]
    gaps = [" ", "  ", "\n", "\r\n", "\t", "\x0b", "\n \n"]
    made = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = ["one two three four five six seven eight nine\n"] * 2
    return [*made, "".join(rows), "w " * 9, "w " * 8, "\n\n", "", None, " \n x\n x\n x \n", *(t for _, t, *_ in EDGES)]


def test_counts_equal_plain_counting(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in rules.judge(table, rules.untrained()).collect()}
    for k, text in enumerate(texts):
        want = plain_counts(text)
        row = found[k]
        assert tuple(row[c] for c in rules.COUNTS) == want
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        # Without a model everything is at one half, above the threshold.
        assert row["probability"] == 0.5 and row["kept"] == (not row["base_failed"]) and row["review"] == row["kept"]


def plain_model(rows, passes):
    """The same regression, one coordinate at a time."""
    size = (rules._KINDS << rules.BITS) + 1
    w, seen = {}, {}
    for _ in range(passes):
        for at in range(0, len(rows), rules.BATCH):
            batch, g = rows[at : at + rules.BATCH], {}
            for index, value, label in batch:
                margin = w.get(size - 1, 0.0) + sum(w.get(i, 0.0) * v for i, v in zip(index, value))
                error = (1 / (1 + math.exp(-margin)) - label) / len(batch)
                for i, v in zip([*index, size - 1], [*value, 1.0]):
                    g[i] = g.get(i, 0.0) + error * v
            for i in g:
                if i != size - 1:
                    g[i] += rules.L2 * w.get(i, 0.0)
                seen[i] = seen.get(i, 1e-8) + g[i] ** 2
                w[i] = w.get(i, 0.0) - rules.RATE * g[i] / math.sqrt(seen[i])
    return w


def test_weights_equal_a_plain_loop():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "#", "dd."], k=rng.randint(1, 12))) for _ in range(150)]
    rows = []
    for text, words in rules._texts(pa.array(texts)):
        rows.append((*rules._features(rules.text_cells(text, words)), int(b"#" in text)))
    w, want = rules.fit_weights(rows, 3), plain_model([(i.tolist(), v.tolist(), y) for i, v, y in rows], 3)
    assert np.allclose(w[list(want)], list(want.values()), atol=1e-9)
    assert np.count_nonzero(w) <= len(want)


def test_a_margin_is_the_dot_product_of_the_features():
    model = rules.Model(np.random.default_rng(1).normal(size=(rules._KINDS << rules.BITS) + 1).astype(np.float32))
    for text, words in rules._texts(pa.array(["The the THE end. The the", "ß", "", "a b " * 500])):
        cells = rules.text_cells(text, words)
        index, value = rules._features(cells)
        assert math.isclose(model.margin(cells), model.weights[-1] + model.weights[index] @ value, rel_tol=1e-4)


def test_the_sigmoid_is_calibrated():
    rng = np.random.default_rng(3)
    margins = rng.normal(size=4000) * 3
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * margins - 1)))).astype(int)
    slope, offset = rules.fit_sigmoid(margins, labels)
    assert abs(slope - 0.5) < 0.05 and abs(offset + 1) < 0.15
    apart = np.array([-2.0, -1.0, 1.0, 2.0])
    assert all(map(math.isfinite, rules.fit_sigmoid(apart, np.array([0, 0, 1, 1]))))
    assert rules.fit_sigmoid(apart, np.ones(4, int)) == (1.0, 0.0)


def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    away = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = rules.train(docs, labels.filter(~away))
    again = rules.train(docs, labels.filter(~away))
    assert np.array_equal(model.weights, again.weights) and (model.slope, model.offset) == (again.slope, again.offset)
    judged = rules.judge(docs, model).join(labels.filter(away), "doc_id").collect()
    good = [r["probability"] >= rules.KEEP for r in judged if r["label"] == 1]
    bad = [r["probability"] < rules.KEEP for r in judged if r["label"] == 0]
    assert len(bad) > 50 and sum(good) >= 0.98 * len(good) and sum(bad) >= 0.95 * len(bad)
    # Calibrated: the mean probability is near the share of good rows.
    assert abs(np.mean([r["probability"] for r in judged]) - len(good) / len(judged)) < 0.03


def test_edges(spark, edges, none):
    labels = spark.createDataFrame([(4, 1), (5, 1), (9, 0), (None, 1), (6, None), (1, 0), (10, 1), (10, 0)], "doc_id long, label int")
    model = rules.train(edges, labels)
    rows = rules.judge(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["probability"] <= 1 for r in rows)
    blank = [r for r in rows if r["doc_id"] in (1, 2)]
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in blank)
    long = [r for r in rows if r["doc_id"] in (7, 8)]
    assert all(r["n_words"] == 60_001 and r["n_repeat_words"] == 60_000 and r["base_failed"] for r in long)
    assert rules.judge(none, model).count() == 0
    assert not rules.train(none, labels).weights.any() and not rules.train(edges, labels.filter("1 = 0")).weights.any()


def test_query(spark):
    found = queries()["op11_quality_rules"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = found.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(tuple(r[c] for c in rules.COUNTS) == plain_counts(texts[r["doc_id"]]) for r in rows)
