"""Greedy chunk packing that spreads one document over many tasks.

A chunk takes elements until it has reached the soft length or the next one no longer
fits, so each decision depends on the one before.  A document is cut into blocks of
``block`` positions.  Within a block the packing is a fold over the sorted elements,
given the length of the chunk that is open when the block begins.  That length is 0 for
the first block, which is all there is for most documents.  For later blocks a task
works out the outcome for every possible length at once (there are ``max_characters``
of them), and one small row per block then tells where each block really starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.ordered import block_of, mark_long, ordered_join
from quire.functions.text import present

MAX_CHARACTERS = 1000
NEW_AFTER_N_CHARS = 800
OVERLAP = 50
SEPARATOR = "\n\n"
BLOCK = 512

# Task functions are made inside others, so that Spark ships them by value and executors
# need numpy and pandas but not this package.
_RUNS = "doc_id bigint, block int, titles bigint, starts array<int>, ends array<int>, counts array<bigint>"
_CARRY = "doc_id bigint, block int, start_open int, chunk_base bigint, section_base bigint, is_last boolean"


def piece_count(n: Column, max_characters: int, overlap: int) -> Column:
    step = max_characters - overlap
    return F.when(n > max_characters, F.ceil((n - overlap) / step).cast("int")).otherwise(1)


def _check(max_characters: int, new_after: int, overlap: int) -> None:
    if not 0 <= overlap <= max_characters // 2:
        raise ValueError("overlap must be between 0 and half of max_characters")
    if not 0 < new_after <= max_characters:
        raise ValueError("new_after_n_chars must be between 1 and max_characters")


def with_pieces(df: DataFrame, text: str, max_characters: int, overlap: int) -> DataFrame:
    """Replace ``text`` by rows ``(piece, piece_text)`` of at most ``max_characters``.

    A long text is cut once into steps; a piece is a step and the head of the next, so
    the work stays linear in the length of the text.
    """
    step = max_characters - overlap
    n = F.length(text)
    steps = F.when(
        n > max_characters, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    )
    cut = df.withColumn("__steps", steps)
    long_pieces = F.slice(
        F.transform(
            "__steps",
            lambda s, i: F.concat(s, F.substring(F.coalesce(F.get("__steps", i + 1), F.lit("")), 1, overlap)),
        ),
        F.lit(1),
        piece_count(n, max_characters, overlap),
    )
    pieces = F.coalesce(long_pieces, F.array(text))
    kept = [c for c in df.columns if c != text]
    return cut.select(*kept, F.posexplode(pieces).alias("piece", "piece_text"))


def split_oversized(
    elements: DataFrame, max_characters: int = MAX_CHARACTERS, overlap: int = OVERLAP
) -> DataFrame:
    """Every element as one or more overlapping pieces."""
    _check(max_characters, max_characters, overlap)
    rows = elements.select("doc_id", "element_index", "element_type", "text")
    return with_pieces(rows, "text", max_characters, overlap)


def _block_runs(max_characters: int, new_after: int, overlap: int):
    """Task function: what a block does to each possible open length, run-length coded."""
    step, maximum = max_characters - overlap, max_characters

    def outcome(lengths: np.ndarray, forced: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        # Nothing is open before the first block.
        starts = 1 if first else max_characters + 1
        opened, which = np.arange(starts), np.arange(starts)
        counts, more = np.zeros(starts, dtype=np.int64), np.zeros(starts, dtype=np.int64)
        items = list(zip(lengths.tolist(), forced.tolist()))
        at = 0
        while at < len(items) and len(opened) > 1:
            n, force = items[at]
            pieces = 1 if n <= maximum else -(-(n - overlap) // step)
            joined = opened + 2 + n
            new = (opened == 0) | (opened >= new_after) | (joined > maximum) | force
            opened = np.where(new, n - (pieces - 1) * step, joined)
            more = more + np.where(new, pieces, 0)
            at += 1
            if at % 4 == 0 or at == len(items):
                # Starts that have met stay together; go on with one of each.
                counts = counts + more[which]
                opened, back = np.unique(opened, return_inverse=True)
                which, more = back.reshape(-1)[which], np.zeros(len(opened), dtype=np.int64)
        counts = counts + more[which]
        if at == len(items):
            return opened[which], counts
        one, added = int(opened[0]), 0
        for n, force in items[at:]:
            if force or one == 0 or one >= new_after or one + 2 + n > maximum:
                pieces = 1 if n <= maximum else -(-(n - overlap) // step)
                one, added = n - (pieces - 1) * step, added + pieces
            else:
                one += 2 + n
        return np.full(starts, one), counts + added

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, block, lengths, forced in zip(
                batch["doc_id"], batch["block"], batch["lengths"], batch["forced"]
            ):
                ends, counts = outcome(np.asarray(lengths), np.asarray(forced), block == 0)
                change = np.flatnonzero(np.diff(ends) | np.diff(counts)) + 1
                starts = np.concatenate([[0], change])
                rows.append((doc_id, block, int(np.sum(forced)), starts.tolist(), ends[starts].tolist(), counts[starts].tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "block", "titles", "starts", "ends", "counts"])

    return run


def _carry():
    """Task function over blocks sorted by document: the state in which each one starts."""
    columns = ["doc_id", "block", "start_open", "chunk_base", "section_base", "is_last"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, state, held = None, (0, 0, 0), None
        for batch in batches:
            rows = []
            for doc_id, block, titles, starts, ends, counts in batch.itertuples(index=False):
                if held is not None:
                    rows.append((*held, doc_id != doc))
                if doc_id != doc:
                    doc, state = doc_id, (0, 0, 0)
                opened, chunks, sections = state
                held = (doc_id, block, opened, chunks, sections)
                at = int(np.searchsorted(starts, opened, side="right")) - 1
                state = (int(ends[at]), chunks + int(counts[at]), sections + int(titles))
            yield pd.DataFrame(rows, columns=columns)
        if held is not None:
            yield pd.DataFrame([(*held, True)], columns=columns)

    return run


def _sized(elements: DataFrame, by_title: bool, block: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """The keyed elements, and those that are not blank with block, length and title mark."""
    keyed = elements.filter(F.col("doc_id").isNotNull() & F.col("element_index").isNotNull())
    title = (F.col("element_type") == "Title") if by_title else F.lit(False)
    rows = (
        keyed.filter(present(F.col("text")))
        .select(
            "doc_id",
            block_of("element_index", block).alias("block"),
            "element_index",
            F.length("text").alias("n"),
            title.alias("title"),
            *more,
        )
        .filter(F.col("block").isNotNull())
    )
    return keyed, rows


def _block_carry(keyed: DataFrame, rows: DataFrame, max_characters: int, new_after: int, overlap: int, block: int) -> DataFrame:
    """The state in which each block of a long document starts.

    Only documents that reach a second block need it, and only their lengths are sent for
    it.  Most inputs have no such document; this branch is then dropped.
    """
    sizes = mark_long(rows.select("doc_id", "block", "element_index", "n", "title"), "block", keyed, block)
    return (
        sizes.filter("__long")
        .groupBy("doc_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("element_index", "n", "title"))).alias("sizes"))
        .select("doc_id", "block", F.col("sizes.n").alias("lengths"), F.col("sizes.title").alias("forced"))
        .mapInPandas(_block_runs(max_characters, new_after, overlap), _RUNS)
        .repartition("doc_id")
        .sortWithinPartitions("doc_id", "block")
        .mapInPandas(_carry(), _CARRY)
    )


def _opens(state: Column, item: Column, max_characters: int, new_after: int) -> Column:
    """Whether an element opens a chunk."""
    return (
        item["title"]
        | (state["open"] == 0)
        | (state["open"] >= new_after)
        | (state["open"] + 2 + item["n"] > max_characters)
    )


def chunk_elements(
    elements: DataFrame,
    strategy: str = "basic",
    max_characters: int = MAX_CHARACTERS,
    new_after_n_chars: int = NEW_AFTER_N_CHARS,
    overlap: int = OVERLAP,
    block: int = BLOCK,
) -> DataFrame:
    """Chunks ``(doc_id, chunk_index, section, text, orig)``; blank elements are left out.

    ``by_title`` opens a chunk at every Title; any other strategy is ``basic``.  ``orig``
    names the elements of the chunk by position and piece, which is enough to join back
    and does not repeat long texts.
    """
    _check(max_characters, new_after_n_chars, overlap)
    by_title = strategy == "by_title"
    step = max_characters - overlap
    keyed, rows = _sized(elements, by_title, block, "element_type", "text")
    item = F.struct("element_index", "n", "title", "element_type", "text")
    blocks = rows.groupBy("doc_id", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def advance(state: Column, item: Column) -> Column:
        n = item["n"]
        pieces = piece_count(n, max_characters, overlap)
        new = _opens(state, item, max_characters, new_after_n_chars)
        section = state["section"] + item["title"].cast("int")
        first = F.when(new, state["chunk"] + 1).otherwise(state["chunk"])
        return F.struct(
            F.when(new, n - (pieces - 1) * step).otherwise(state["open"] + 2 + n).alias("open"),
            F.when(new, state["chunk"] + pieces).otherwise(state["chunk"]).alias("chunk"),
            section.alias("section"),
            F.array_append(state["chunks"], first).alias("chunks"),
            (F.array_append(state["sections"], section) if by_title else state["sections"]).alias("sections"),
        )

    start = F.struct(
        F.coalesce("start_open", F.lit(0)).alias("open"),
        F.lit(-1).alias("chunk"),
        F.lit(0).alias("section"),
        F.array().cast("array<int>").alias("chunks"),
        F.array().cast("array<int>").alias("sections"),
    )
    packed = F.aggregate("items", start, advance).alias("state")
    carry = _block_carry(keyed, rows, max_characters, new_after_n_chars, overlap, block)

    def chunk_parts(df: DataFrame) -> DataFrame:
        """Rows ``(doc_id, block, chunk_index, ...)``: what a block gives to each chunk."""
        base = F.coalesce("chunk_base", F.lit(0))
        last = base + F.col("state.chunk")
        marked = df.select("*", packed).select(
            "doc_id",
            "block",
            base.alias("base"),
            last.alias("last"),
            F.coalesce("section_base", F.lit(0)).alias("section_base"),
            F.coalesce("is_last", F.lit(True)).alias("is_last"),
            F.explode(
                F.arrays_zip(
                    F.col("items").alias("item"),
                    F.col("state.chunks").alias("chunk"),
                    F.col("state.sections").alias("section"),
                )
            ).alias("x"),
        )
        rows = marked.select(
            "doc_id",
            "block",
            "base",
            "last",
            "is_last",
            (F.col("section_base") + F.coalesce("x.section", F.lit(0))).alias("section"),
            (F.col("base") + F.col("x.chunk")).alias("first"),
            F.col("x.item.element_index").alias("element_index"),
            F.col("x.item.element_type").alias("element_type"),
            F.col("x.item.text").alias("text"),
        )
        return with_pieces(rows, "text", max_characters, overlap).select(
            "doc_id",
            "block",
            (F.col("first") + F.col("piece")).alias("chunk_index"),
            "section",
            "element_index",
            "element_type",
            "piece",
            "piece_text",
            # A chunk that an earlier block opened, or that a later block may add to.
            (
                (F.col("first") + F.col("piece") == F.col("base") - 1)
                | ((F.col("first") + F.col("piece") == F.col("last")) & ~F.col("is_last"))
            ).alias("crosses"),
        )

    def build(parts: DataFrame, keys: list[str]) -> DataFrame:
        place = F.struct("element_index", "piece")
        return parts.groupBy(*keys).agg(
            F.min("section").alias("section"),
            ordered_join(place, F.col("piece_text"), SEPARATOR).alias("text"),
            F.sort_array(
                F.collect_list(F.struct("element_index", "piece", "element_type", F.length("piece_text").alias("n_chars")))
            ).alias("orig"),
        )

    out = ["doc_id", "chunk_index", "section", "text", "orig"]
    # Grouping by (doc_id, block, chunk) keeps the partitioning of the blocks: no shuffle.
    inner = build(
        chunk_parts(blocks.join(carry, ["doc_id", "block"], "left")).filter(~F.col("crosses")),
        ["doc_id", "block", "chunk_index"],
    )
    crossing = build(
        chunk_parts(blocks.join(carry, ["doc_id", "block"])).filter("crosses"), ["doc_id", "chunk_index"]
    )
    return inner.select(*out).unionByName(crossing.select(*out))


def chunk_counts(
    elements: DataFrame,
    strategy: str = "basic",
    max_characters: int = MAX_CHARACTERS,
    new_after_n_chars: int = NEW_AFTER_N_CHARS,
    overlap: int = OVERLAP,
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, chunk_count, strategy)``: how many chunks each document has.

    Only lengths are shuffled: no chunk is built and no text leaves its task.
    """
    _check(max_characters, new_after_n_chars, overlap)
    step = max_characters - overlap
    keyed, rows = _sized(elements, strategy == "by_title", block)
    blocks = rows.groupBy("doc_id", "block").agg(F.sort_array(F.collect_list(F.struct("element_index", "n", "title"))).alias("items"))

    def advance(state: Column, item: Column) -> Column:
        pieces = piece_count(item["n"], max_characters, overlap)
        new = _opens(state, item, max_characters, new_after_n_chars)
        return F.struct(
            F.when(new, item["n"] - (pieces - 1) * step).otherwise(state["open"] + 2 + item["n"]).alias("open"),
            F.when(new, state["count"] + pieces).otherwise(state["count"]).alias("count"),
        )

    start = F.struct(F.coalesce("start_open", F.lit(0)).alias("open"), F.coalesce("chunk_base", F.lit(0)).cast("long").alias("count"))
    carry = _block_carry(keyed, rows, max_characters, new_after_n_chars, overlap, block)
    counted = blocks.join(carry, ["doc_id", "block"], "left").select("doc_id", F.aggregate("items", start, advance)["count"].alias("n"))
    return counted.groupBy("doc_id").agg(F.max("n").alias("chunk_count")).withColumn("strategy", F.lit(strategy))
