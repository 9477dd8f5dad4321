"""Quality scores: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features are runs of letters and digits, runs of other marks, and pairs of neighbours;
a pair of equal neighbours is one feature of its own, whatever the word.  Hashes fall
into 2**18 coordinates, values are log counts scaled to length one, and a score is the
logistic of a sparse dot product with the weights.

Training takes a bounded sample: at most ``max_rows`` labelled rows, chosen by hashes of
their ids.  Their features are computed where the texts lie; the updates, which
are sequential by nature, run in one task over that sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.sample import hashed_sample
from quire.llm.words import Alphabet, hashed_words, mix
from quire.session import share_code

BITS = 18
#: Bound of the training sample, in rows.
MAX_ROWS = 20_000
PASSES = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.0002
_REPEATED = np.uint64(0x51ED270B0A1B2C3D)


def text_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Coordinates and values of each text; both empty for texts without words."""
    for _, counts, words in hashed_words(texts, Alphabet.words_and_marks()):
        text = np.repeat(np.arange(len(counts)), counts)
        together = text[1:] == text[:-1]
        left, right = words[:-1][together], words[1:][together]
        pairs = np.where(left == right, _REPEATED, mix(left * np.uint64(3) + right))
        key = np.concatenate((words, pairs)) >> np.uint64(64 - BITS)
        owner = np.concatenate((text, text[1:][together])).astype(np.uint64)
        cells, times = np.unique((owner << np.uint64(BITS)) | key, return_counts=True)
        values = np.log1p(times)
        at = np.searchsorted(cells, np.arange(len(counts) + 1, dtype=np.uint64) << np.uint64(BITS))
        index = (cells & np.uint64((1 << BITS) - 1)).astype(np.int32)
        for a, b in zip(at[:-1], at[1:]):
            x = values[a:b]
            yield index[a:b], x / max(np.sqrt(x @ x), 1e-9)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(features(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("turn"),
                batch.column("label"),
                pa.array([i for i, _ in rows], pa.list_(pa.int32())),
                pa.array([x for _, x in rows], pa.list_(pa.float64())),
            ],
            names=["turn", "label", "index", "value"],
        )


class Ftrl:
    """Follow-the-regularised-leader state; the last coordinate is the intercept."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, value = np.append(index, 1 << BITS), np.append(value, 1.0)
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
        self.z[index] += g - (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / ALPHA * w
        self.n[index] += g * g


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Ftrl()
    for batch in batches:
        for index, value, label in zip(batch.column("index"), batch.column("value"), batch.column("label").to_pylist()):
            model.learn(index.values.to_numpy(), value.values.to_numpy(), label)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights().tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, passes: int = PASSES) -> np.ndarray:
    """Weights learned from ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``.

    Rows without id, label or text are left out; without any row all weights are zero.
    Rows that share a doc_id are all learned, with the higher of its labels; rows of one
    turn are learned in the order of their labels.  Other columns are not read.
    """
    share_code(docs.sparkSession)
    turn = F.xxhash64("doc_id")
    usable = labels.select(F.col("doc_id"), F.col("label").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    # Two labels of one document become the higher one.
    sample = hashed_sample(usable.groupBy("doc_id").agg(F.max("label").alias("label")), max_rows, "doc_id")
    # At most max_rows rows of two numbers.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    chosen = texts.join(F.broadcast(sample), "doc_id").select(turn.alias("turn"), "label", "text")
    rows = chosen.mapInArrow(_feature_batches, "turn long, label int, index array<int>, value array<double>")
    again = F.explode(F.sequence(F.lit(1), F.lit(passes)))
    ordered = rows.withColumn("pass", again).repartition(1).sortWithinPartitions("pass", "turn", "label")
    learned = ordered.drop("pass").mapInArrow(_training, "weights binary").collect()
    if not learned:  # adaptive execution drops the task where the sample is empty
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.frombuffer(learned[0]["weights"]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score, predicted.

    Null, empty and wordless texts get the score of the intercept.  Repeated rows are
    scored each for itself; other columns are not read.
    """
    share_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 numbers

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in rows:
            found = [w[i] @ x + w[-1] for i, x in features(batch.column("text"))]
            scores = 1 / (1 + np.exp(-np.clip(np.array(found, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
