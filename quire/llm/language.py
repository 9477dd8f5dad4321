"""Language identification by a byte convolutional network, in numpy.

A window of 256 bytes goes through filters two to four bytes wide, whose largest
response over the window, cut at zero, is a feature; a softmax layer gives the language.
A filter has one weight for each of its positions and each byte, so its response is a
sum of table entries.  Texts are cut into windows from their first to their last byte,
the last one filled up with zero bytes, and the log probabilities of all windows add up.

Training takes a bounded sample: windows of at most ``max_rows`` labelled texts, chosen by
hashes of their ids, ``WINDOWS_EACH`` evenly spaced ones and a short one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.sample import hashed_sample
from quire.session import share_code

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bound of the training sample, in texts, and of the windows taken from each.
MAX_ROWS = 6_000
WINDOWS_EACH = 2
PASSES = 6
UNKNOWN = "und"
_CHUNK = 256


def windows(data: bytes) -> np.ndarray:
    """All bytes of a text as rows of one window each; an empty text has none."""
    rows = -(-len(data) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, WINDOW)


class ByteCnn:
    """Filter tables ``f[k]`` (width, byte, filter), biases, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.languages = languages
        n = FILTERS * len(WIDTHS)
        self.parts = {f"f{w}": draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:
            self.parts[f"f{w}"][:, 0, :] = -1  # filling attracts no filter
        self.parts["c"] = np.zeros(n, np.float32)
        self.parts["v"] = draw.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.parts["b"] = np.zeros(len(languages), np.float32)

    def pairs(self) -> dict[int, list[np.ndarray]]:
        """Filters as tables over two bytes at a time (and one, for an odd width)."""
        tables = {}
        for w in WIDTHS:
            f = self.parts[f"f{w}"]
            tables[w] = [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
            if w % 2:
                tables[w].append(f[w - 1])
        return tables

    def pooled(self, x: np.ndarray, tables: dict[int, list[np.ndarray]], places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each window, and where it is."""
        two = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        best, at = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            total = None
            for j, table in enumerate(tables[w]):
                part = table[two[:, 2 * j : 2 * j + n] if len(table) == 65536 else x[:, 2 * j : 2 * j + n]]
                total = part if total is None else np.add(total, part, out=total)
            if places:
                at.append(total.argmax(1))
            best.append(total.max(1))
        return np.concatenate(best, 1) + self.parts["c"], np.concatenate(at, 1) if places else None

    def log_probabilities(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for a in range(0, len(x), _CHUNK):
            h, _ = self.pooled(x[a : a + _CHUNK], tables)
            out[a : a + _CHUNK] = _log_softmax(np.maximum(h, 0) @ self.parts["v"] + self.parts["b"])
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, at = self.pooled(x, self.pairs(), places=True)
        active = np.maximum(h, 0)
        error = np.exp(_log_softmax(active @ self.parts["v"] + self.parts["b"]))
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ self.parts["v"].T) * (h > 0)
        grads = {"v": active.T @ error, "b": error.sum(0), "c": back.sum(0)}
        rows = np.arange(len(x))[:, None]
        lanes = np.arange(FILTERS)[None, :]
        for k, w in enumerate(WIDTHS):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            g = np.zeros((w, 256, FILTERS), np.float32)
            for j in range(w):
                np.add.at(g[j], (x[rows, at[:, part] + j], lanes), back[:, part])
            grads[f"f{w}"] = g
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int, seed: int = 11, batch: int = 128, rate: float = 0.01) -> None:
        """Adam on cross-entropy, in an order fixed by the seed."""
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.parts.items()}
        second = {k: np.zeros_like(v) for k, v in self.parts.items()}
        step = 0
        for p in range(passes):
            order = draw.permutation(len(x))
            for a in range(0, len(x), batch):
                step += 1
                chosen = order[a : a + batch]
                for k, g in self.gradient(x[chosen], y[chosen]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    size = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                    self.parts[k] -= rate * (1 - 0.8 * p / passes) * size


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept: list[list[bytes]] = []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            rows = windows(text)
            # The last window may be short; a text of several windows shows whole ones.
            full = rows[: max(1, len(text) // WINDOW)]
            some = full[np.unique(np.linspace(0, len(full) - 1, WINDOWS_EACH).astype(int))]
            short = rows[:1].copy()
            short[:, 48:] = 0  # short texts occur as well
            kept.append([r.tobytes() for r in (*some, *short)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("turn"), batch.column("lang"), pa.array(kept, pa.list_(pa.binary()))],
            names=["turn", "lang", "windows"],
        )


def train(docs: DataFrame, max_rows: int = MAX_ROWS, passes: int = PASSES) -> ByteCnn | None:
    """A network learned from the rows of ``docs`` with text and lang; None without any.

    At most ``max_rows`` times ``WINDOWS_EACH + 1`` windows of 256 bytes come to the driver.
    Repeated rows are learned as often as they stand, if they are chosen; which rows are
    follows from hashes of id and text.  Other columns are not read.
    """
    share_code(docs.sparkSession)
    rows = docs.select(
        F.xxhash64("doc_id").alias("turn"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).filter("lang IS NOT NULL AND text <> ''")
    chosen = hashed_sample(rows, max_rows, "turn", F.crc32("text"))
    sample = chosen.mapInArrow(_training_windows, "turn long, lang string, windows array<binary>").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["turn"], r["lang"], r["windows"]))  # whatever came first
    languages = sorted({r["lang"] for r in sample})
    x = np.frombuffer(b"".join(w for r in sample for w in r["windows"]), np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(r["lang"]) for r in sample for _ in r["windows"]])
    model = ByteCnn(languages)
    model.fit(x, y, passes)
    return model


def identify(docs: DataFrame, model: ByteCnn | None, keep: list[Column]) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (a struct of ``keep``), lang_pred, score.

    The score is the share of the predicted language, from 0 to 1, where each window
    counts alike.  Null texts and texts without a letter are ``und`` with score 0; so is
    every text if nothing could be learned.  Equal shares go to the first language in
    order.  Repeated rows are judged each for itself; columns are only read through ``keep``.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*keep).alias("row"), F.when(letters, F.col("text").cast("string")).alias("text"))
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    share_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.pairs()
        for batch in batches:
            texts = batch.column("text")
            sums = np.zeros((len(texts), len(net.languages)))
            for a in range(0, len(texts), 64):
                rows = [windows(t) for t in texts.slice(a, 64).fill_null("").cast(pa.binary()).to_pylist()]
                counts = np.array([len(r) for r in rows])
                if counts.sum():
                    logs = net.log_probabilities(np.concatenate(rows), tables)
                    full = np.flatnonzero(counts)
                    sums[a + full] = np.add.reduceat(logs, (np.cumsum(counts) - counts)[full], 0) / counts[full, None]
            shares = np.exp(_log_softmax(sums))
            known = texts.is_valid().to_numpy(zero_copy_only=False)
            names = [net.languages[k] if ok else UNKNOWN for k, ok in zip(shares.argmax(1), known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names, pa.string()), pa.array(np.where(known, shares.max(1), 0.0))],
                names=["row", "lang_pred", "score"],
            )

    return rows.mapInArrow(batches, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def relabel(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """``docs`` with the language found as ``lang``, without the documents that have none.

    Where nothing could be learned, nothing is rejected and ``lang`` stays.
    """
    if model is None:
        return docs
    found = identify(docs, model, [F.col(f"`{c}`") for c in docs.columns]).filter(F.col("lang_pred") != UNKNOWN)
    columns = [F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*columns)
