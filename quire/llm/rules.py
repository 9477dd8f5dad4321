"""Quality rules: counts that bound what is text, and a calibrated classifier's verdict.

The classifier is a logistic regression on hashed n-grams, learned from labelled rows.
Word n-grams are words and pairs of neighbours (a pair of equal neighbours is one feature,
whatever the word), character n-grams are runs of bytes.  Each kind falls into 2**17
coordinates of its own and is a share of the text's n-grams of that kind, so a score is a
sum of mean weights and texts are read once, without sorting their features.

Its margins become probabilities by Platt's sigmoid, fitted to rows that the weights have
not seen.  Probabilities are held against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.sample import hashed_sample
from quire.llm.words import Alphabet, hashed_words, mix, text_windows
from quire.session import share_code

#: Fixed thresholds: fewer words, or a larger part of them in repeated windows, fail
#: outright; below KEEP a text is dropped, below SURE it is kept but marked for review.
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
KEEP, SURE = 0.4, 0.8
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

BITS = 17
CHARACTERS = (3, 5)
#: Bound of the labelled rows that are learned from, in rows.
MAX_ROWS = 8_000
#: One labelled row in so many is kept back for the calibration.
CALIBRATE = 4
PASSES = 4
BATCH = 64
RATE, L2, SCALE = 0.5, 1e-6, 8.0
_EQUAL = np.uint64(0x2545F4914F6CDD1D)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KINDS = 1 + len(CHARACTERS)
_PLAIN = Alphabet.unspaced(fold=False)


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def _character_cells(data: np.ndarray, size: int) -> np.ndarray:
    """Coordinates of all runs of ``size`` bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return (h * _ODD >> np.uint64(64 - BITS)).astype(np.uint32)


def _word_cells(words: np.ndarray) -> np.ndarray:
    left, right = words[:-1], words[1:]
    pairs = np.where(left == right, _EQUAL, mix(left * np.uint64(3) + right))
    return (np.concatenate((words, pairs)) >> np.uint64(64 - BITS)).astype(np.uint32)


def text_cells(text: bytes, words: np.ndarray) -> list[np.ndarray]:
    """For each kind of n-gram, the coordinates of those that stand in a text."""
    data = _bytes(text)
    found = [_word_cells(words), *[_character_cells(data, size) for size in CHARACTERS]]
    return [cells + np.uint32(k << BITS) for k, cells in enumerate(found)]


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_STARTS = np.ones(256, bool)
_STARTS[0x80:0xC0] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def repeated_words(words: np.ndarray) -> int:
    """Words inside runs of ``WINDOW`` words that stand at least twice in the text."""
    found, first, _ = text_windows(words, np.array([len(words)]), WINDOW)
    if not len(found):
        return 0
    _, where, times = np.unique(found, return_inverse=True, return_counts=True)
    starts = first[times[where] > 1]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def counts(text: bytes, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    data = _bytes(text)
    chars = int((_STARTS[data] & ~_SEPARATOR[data]).sum())
    return len(words), chars, int(_SYMBOL[data].sum()), repeated_lines(text), repeated_words(words)


def _texts(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text's bytes and the hashes of its words."""
    raw = column.cast(pa.large_binary()).fill_null(b"")
    for first, sizes, words in hashed_words(raw, _PLAIN):
        ends = np.cumsum(sizes)
        for k, (a, b) in enumerate(zip(ends - sizes, ends)):
            yield raw[first + k].as_py(), words[a:b]


@dataclass
class Model:
    """Weights of all coordinates and an intercept; the sigmoid's slope and offset."""

    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, cells: list[np.ndarray]) -> float:
        return float(self.weights[-1]) + SCALE * sum(float(self.weights[c].mean()) for c in cells if len(c))

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def untrained() -> Model:
    return Model(np.zeros((_KINDS << BITS) + 1, np.float32))


Row = tuple[np.ndarray, np.ndarray, int]


def _features(cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates of a text, and their values."""
    index, value = [], []
    for part in cells:
        found, times = np.unique(part, return_counts=True)
        index.append(found.astype(np.int64))
        value.append(SCALE * times / max(len(part), 1))
    return np.concatenate(index), np.concatenate(value)


def fit_weights(rows: list[Row], passes: int = PASSES) -> np.ndarray:
    """Logistic regression by AdaGrad over small batches, in the rows' order."""
    size = (_KINDS << BITS) + 1
    w, seen = np.zeros(size), np.full(size, 1e-8)
    for _ in range(passes):
        for at in range(0, len(rows), BATCH):
            batch = rows[at : at + BATCH]
            lengths = [len(i) for i, _, _ in batch]
            index = np.concatenate([i for i, _, _ in batch])
            value = np.concatenate([v for _, v, _ in batch])
            owner = np.repeat(np.arange(len(batch)), lengths)
            margins = np.bincount(owner, w[index] * value, len(batch)) + w[-1]
            error = (1 / (1 + np.exp(-np.clip(margins, -30, 30))) - np.array([y for _, _, y in batch])) / len(batch)
            cells, where = np.unique(index, return_inverse=True)
            g = np.bincount(where, error[owner] * value) + L2 * w[cells]
            cells, g = np.append(cells, size - 1), np.append(g, error.sum())
            seen[cells] += g * g
            w[cells] -= RATE * g / np.sqrt(seen[cells])
    return w


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's slope and offset by Newton's method; with softened labels, so both are finite."""
    good = int(labels.sum())
    if not good or good == len(labels):
        return 1.0, 0.0
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    x = np.column_stack((margins, np.ones(len(margins))))
    theta = np.array([1.0, 0.0])
    loss = lambda t: float(np.sum(np.logaddexp(0, x @ t) - target * (x @ t)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
        rate = 1.0
        while rate > 1e-6 and loss(theta - rate * step) > loss(theta):
            rate /= 2
        theta = theta - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[Row] = []
    apart: list[tuple[list[np.ndarray], int]] = []
    for batch in batches:
        labels, back = batch.column("label").to_pylist(), batch.column("back").to_pylist()
        for k, (text, words) in enumerate(_texts(batch.column("text"))):
            cells = text_cells(text, words)
            if back[k]:
                apart.append((_features(cells), labels[k]))
            else:
                rows.append((*_features(cells), labels[k]))
    if not rows:
        return
    model = Model(fit_weights(rows).astype(np.float32))
    margins = np.array([float(model.weights[-1]) + float(model.weights[i] @ v) for (i, v), _ in apart])
    if apart:
        model.slope, model.offset = fit_sigmoid(margins, np.array([y for _, y in apart]))
    arrays = [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.slope]), pa.array([model.offset])]
    yield pa.RecordBatch.from_arrays(arrays, names=["weights", "slope", "offset"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``.

    Rows without id, label or text are left out; several labels of one document become
    the higher one; every row of a repeated doc_id is learned.  At most ``max_rows``
    labelled documents, chosen by hashes of their ids, go to the one task that learns.
    Without any row all weights are zero and probabilities one half.
    """
    share_code(docs.sparkSession)
    usable = labels.select(F.col("doc_id"), F.col("label").cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    sample = hashed_sample(usable.groupBy("doc_id").agg(F.max("label").alias("label")), max_rows, "doc_id")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    turn = F.xxhash64("doc_id", F.lit(7))
    # At most max_rows rows of two numbers are broadcast.
    rows = texts.join(F.broadcast(sample), "doc_id").select(turn.alias("turn"), "label", (F.pmod(turn, F.lit(CALIBRATE)) == 0).alias("back"), "text")
    ordered = rows.repartition(1).sortWithinPartitions("turn", "label", "text").drop("turn")
    learned = ordered.mapInArrow(_training, "weights binary, slope double, offset double").collect()
    if not learned:
        return untrained()
    return Model(np.frombuffer(learned[0]["weights"], np.float32), learned[0]["slope"], learned[0]["offset"])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model, keep: float = KEEP, sure: float = SURE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts, probability, base_failed, kept, review.

    ``base_failed`` texts are too short or too repetitive, whatever the model says; the
    others are kept from a probability of ``keep`` on, and marked for review below
    ``sure``.  Null and empty texts have no words and fail.  Repeated rows are judged each
    for itself; other columns are not read.
    """
    spark = docs.sparkSession
    share_code(spark)
    shared = spark.sparkContext.broadcast(model)  # _KINDS * 2**BITS + 1 numbers

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in rows:
            found, margins = [], []
            for text, words in _texts(batch.column("text")):
                found.append(counts(text, words))
                margins.append(m.margin(text_cells(text, words)))
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * len(COUNTS)
            score = pa.array(m.probability(np.array(margins, np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, score], names=["doc_id", *COUNTS, "probability"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", probability double"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(batches, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    kept = ~F.col("base_failed") & (F.col("probability") >= keep)
    return rows.withColumn("base_failed", failed).withColumn("kept", kept).withColumn("review", kept & (F.col("probability") < sure))
