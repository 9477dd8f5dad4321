"""Benchmark decontamination: documents are searched for windows of benchmark items.

A window is ten consecutive words of an item; an item of fewer words, but not none, is
one window.  The hashes of all windows form a set that every task has; documents pass
over it in one scan, without a shuffle, and a hash that is found counts only once the
words themselves have been compared.  The set is broadcast in blocks of at most
``WINDOWS_PER_BLOCK`` windows, counted before; a larger benchmark takes more passes over
the text in the same job, so no task ever holds more than one block for each pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.words import Alphabet, hashed_words, signed, text_windows, windows
from quire.session import share_code

WINDOW = 10
WINDOWS_PER_BLOCK = 500_000

SPAN = "struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint>"
REPORT = f"n_words bigint, n_hit bigint, spans array<{SPAN}>, items array<string>"
_SPAN_TYPE = pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start", "end")])

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items: size, hash, item and words."""
    for batch in batches:
        out: list[tuple[int, int, str | None, str]] = []
        items = batch.column("item").to_pylist()
        for item, text in zip(items, batch.column("text").to_pylist()):
            words = _WORD.findall((text or "").translate(_UPPER))
            if not words:
                continue
            hashes = np.concatenate([h for *_, h in hashed_words(pa.array([text]), Alphabet.alphanumeric())])
            size = min(WINDOW, len(words))
            for at, h in enumerate(signed(windows(hashes, size)).tolist()):
                out.append((size, h, item, " ".join(words[at : at + size])))
        columns = zip(*out) if out else ((), (), (), ())
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["size", "hash", "item", "words"]
        )


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows (size, hash, item, words) of a benchmark table (item_id, text)."""
    share_code(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string"))
    return rows.mapInArrow(_item_batches, "size int, hash long, item string, words string").distinct()


class _Block:
    """A block of windows in a task: sorted hashes by window size, and what they stand for."""

    def __init__(self, table: pa.Table) -> None:
        self.item, self.words = table["item"].to_pylist(), table["words"].to_pylist()
        sizes = table["size"].to_numpy()
        hashes = table["hash"].to_numpy().view(np.uint64)
        self.by_size = {}
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            rows = rows[np.argsort(hashes[rows])]
            maybe = np.zeros(1 << 20, bool)  # most windows end at this table
            maybe[hashes[rows] >> np.uint64(44)] = True
            self.by_size[int(size)] = (hashes[rows], rows, maybe)

    def hits(self, words: np.ndarray, counts: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By text: (first word, window size, window row) of every equal hash."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        begins = np.cumsum(counts) - counts
        for size, (hashes, rows, maybe) in self.by_size.items():
            h, at, text = text_windows(words, counts, size)
            some = np.flatnonzero(maybe[h >> np.uint64(44)])
            low, high = np.searchsorted(hashes, h[some]), np.searchsorted(hashes, h[some], "right")
            for k in np.flatnonzero(high > low):
                i = some[k]
                for row in rows[low[k] : high[k]]:
                    found.setdefault(int(text[i]), []).append((int(at[i] - begins[text[i]]), size, int(row)))
        return found

    def report(self, text: str, hits: list[tuple[int, int, int]], marked: list[dict], items: list[str]) -> tuple:
        """Hit words, spans and items of one text, added to those of earlier blocks."""
        words = list(_WORD.finditer(text.translate(_UPPER)))  # of the same length
        places, spelled = [m.span() for m in words], [m.group() for m in words]
        hit = np.zeros(len(places) + 2, np.int64)
        for span in marked:
            hit[span["first_word"] : span["last_word"] + 1] = 1
        named = set(items)
        for at, size, row in hits:
            if " ".join(spelled[at : at + size]) == self.words[row]:
                hit[at : at + size] = 1
                named.add(self.item[row])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit))))
        spans = [
            {"first_word": a, "last_word": b - 1, "start": places[a][0], "end": places[b - 1][1]}
            for a, b in edges.reshape(-1, 2).tolist()
        ]
        return int(hit.sum()), spans, sorted(x for x in named if x is not None)


def _scanner(load: Callable[[], bytes], first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(pa.ipc.open_stream(load()).read_all())
        for batch in batches:
            texts = batch.column("text")
            n = len(texts)
            if first:
                words, spans, items = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
                n_hit = np.zeros(n, np.int64)
            else:
                words, n_hit = batch.column("n_words").to_numpy(), batch.column("n_hit").to_numpy().copy()
                spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for start, counts, hashes in hashed_words(texts, Alphabet.alphanumeric()):
                if first:
                    words[start : start + len(counts)] = counts
                for k, hits in block.hits(hashes, counts).items():
                    i = start + k
                    n_hit[i], spans[i], items[i] = block.report(texts[i].as_py(), hits, spans[i], items[i])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    texts,
                    pa.array(words),
                    pa.array(n_hit),
                    pa.array(spans, pa.list_(_SPAN_TYPE)),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["row", "text", "n_words", "n_hit", "spans", "items"],
            )

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[Column], block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (a struct of ``keep``), text and the report.

    The report is ``REPORT``: words, hit words, spans of hit words with their places in
    the text, and the items found, sorted.  Null and empty texts have no words and
    nothing is found in them; likewise in an empty benchmark.  A window of an item
    without id marks words but names no item.  Equal windows of several items name all.
    """
    spark = docs.sparkSession
    found = item_windows(benchmark).persist()
    try:
        blocks = max(1, -(-found.count() // block))
        part = F.pmod(F.xxhash64("hash", "item", "words"), F.lit(blocks))
        # Each table has about ``block`` rows of a few hundred bytes.
        tables = [found.filter(part == k).toArrow() for k in range(blocks)]
    finally:
        found.unpersist()
    out = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    schema = f"row {out.schema['row'].dataType.simpleString()}, text string, {REPORT}"
    for k, table in enumerate(tables):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        out = out.mapInArrow(_scanner(lambda shared=shared: shared.value, first=k == 0), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or with the spans of hit words cut out.

    The columns of ``docs`` stay as they are, whatever their names; where spans are cut
    out, an ``n_chars`` column follows the text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    found = contamination(docs, benchmark, [F.col(f"`{c}`") for c in docs.columns])
    if remove == "documents":
        return found.filter("n_hit = 0").select("row.*")
    size = F.length("text").cast("long")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(size))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a.cast("int") + 1, (b - a).cast("int")))
    cut = F.when(F.col("n_hit") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    changed = {"text": cut}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_hit") > 0, F.length(cut).cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
