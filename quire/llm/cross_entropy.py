"""Language-model scores: cross-entropy under a target and a background model.

Both are bigram models with absolute discounting over one vocabulary, and are made alike;
only the corpus they count differs (Moore and Lewis, 2010).  Everything is counted over
all documents, and no threshold depends on the size of the corpus: every word has a
probability of its own, and so has every pair that stands at least ``MIN_PAIR`` times;
other pairs back off to single words, and words never counted are one unknown word.

A text's loss is a sum over terms: for each word its single part and the rest of its
context, for each pair what its own probability changes.  The terms are a distributed
table of (key, target, background).  The ``NEAR_TERMS`` most frequent ones are also
broadcast, which only saves work: scoring sums those in place and asks the whole table for
the others.  A question is a row for each range of keys and some thousand texts, which
holds the keys without repeating whose they are; the answer holds sums for each text.
Tables are removed when the last one that is made from them has been written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.llm.stage import discard, stage
from quire.llm.words import Alphabet, hashed_words, mix, signed
from quire.session import share_code

MIN_PAIR = 2
NEAR_TERMS = 2_000_000
#: Words or far terms that a task works on at once, and text for which there is one range of keys.
PORTION = 1 << 21
RANGE_BYTES = 1 << 23
DISCOUNT = 0.5
SIDES = ("target", "background")
#: In place of a word's hash: the text's start and the unknown word.
_START, _UNKNOWN = 0, 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _now_keys(words: np.ndarray) -> np.ndarray:
    return mix(words + np.uint64(3))


def _before_keys(words: np.ndarray) -> np.ndarray:
    return mix(words * _ODD + np.uint64(5))


def _pair_keys(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mix(mix(before + np.uint64(7)) + now)


def _known(words: np.ndarray, vocabulary: np.ndarray | None) -> np.ndarray:
    """Words outside of a sorted vocabulary become the unknown word; without one all stay."""
    if vocabulary is None:
        return words
    if not len(vocabulary):
        return np.full(len(words), _UNKNOWN, np.uint64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, words, np.uint64(_UNKNOWN))


def _before(words: np.ndarray, counts: np.ndarray, start: int = _START) -> np.ndarray:
    """Each word's predecessor in its text."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = start
    return before


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words, words per text and targets of consecutive texts, about ``PORTION`` words at once.

    What is worked out for each word takes tens of bytes; a batch may hold any number of words.
    """
    target = batch.column("target").to_numpy(zero_copy_only=False)
    held, size = [], 0
    for first, counts, found in hashed_words(batch.column("text"), Alphabet.alphanumeric()):
        held.append((found, counts, target[first : first + len(counts)]))
        size += len(found)
        if size >= PORTION:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word stands, and how often as a predecessor, in the target and in all."""
    for batch in batches:
        for words, counts, target in _portions(batch):
            target, counts = target[counts > 0], counts[counts > 0]
            side = np.repeat(target, counts).astype(np.int64)
            distinct, at = np.unique(words, return_inverse=True)
            cells = at * 2 + side
            now = np.bincount(cells, minlength=2 * len(distinct)).reshape(-1, 2)
            # All but the last word of a text are predecessors, and so is each text's start.
            before = now - np.bincount(cells[np.cumsum(counts) - 1], minlength=2 * len(distinct)).reshape(-1, 2)
            now = np.concatenate((now, np.zeros((1, 2), np.int64)))
            before = np.concatenate((before, np.bincount(target.astype(np.int64), minlength=2).reshape(1, 2)))
            columns = [signed(np.append(distinct, np.uint64(_START))), now[:, 1], now.sum(1), before[:, 1], before.sum(1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", *_WORD_SUMS])


_WORD_SUMS = [f"{place}_{side}" for place in ("now", "before") for side in SIDES]


def _word_terms(unknown: dict[str, float]):
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            words = column["word"].view(np.uint64)
            for name, place, keys in (("single", "now", _now_keys(words)), ("left", "before", _before_keys(words))):
                yield _terms(keys, column[f"{place}_background"], [np.log(unknown[f"{name}_{s}"]) - np.log(column[f"{name}_{s}"]) for s in SIDES])

    return terms


def _pair_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        values = []
        for s in SIDES:
            held = np.maximum(column[s] - DISCOUNT, 0) / np.maximum(column[f"before_{s}"], 1)
            rest = column[f"left_{s}"] * column[f"single_{s}"]
            values.append(np.log(rest) - np.log(held + rest))
        keys = _pair_keys(column["before"].view(np.uint64), column["now"].view(np.uint64))
        yield _terms(keys, column["background"], values)


def _terms(keys: np.ndarray, n: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    grade = np.floor(np.log2(np.maximum(n, 1)) * 8).astype(np.int32)
    columns = [signed(keys), grade, *(v.astype(np.float32) for v in values)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "grade", *SIDES])


_TERMS = "key long, grade int, target float, background float"


@dataclass
class Model:
    """The terms that stay distributed, the broadcast ones as arrays, and the unknown word."""

    far: DataFrame
    keys: np.ndarray
    values: np.ndarray
    unknown: dict[str, float]
    vocabulary: np.ndarray | None


def train(docs: DataFrame, word_share: float = 0.0, pair_share: float = 0.0, near_terms: int = NEAR_TERMS) -> Model:
    """Both models from ``docs`` (text, target boolean); the background is all documents.

    Null and empty texts have no words; a null ``target`` is false.  Repeated rows count
    again; other columns are not read.  A ``word_share`` or
    ``pair_share`` above 0 leaves out what makes up less than that share of all tokens.
    """
    spark = docs.sparkSession
    share_code(spark)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("target"), F.lit(False)).alias("target"))
    kind = ", ".join(f"{c} long" for c in ("word", *_WORD_SUMS))
    counted = rows.mapInArrow(_word_counts, kind).groupBy("word").agg(*[F.sum(c).alias(c) for c in _WORD_SUMS])
    words = counts_table = stage(counted, "word-counts")
    tokens = words.agg(F.sum("now_background")).first()[0] or 0
    vocabulary = None
    if word_share:
        rare = (F.col("word") != _START) & (F.col("now_background") < word_share * tokens)
        # At most 1 / word_share rows.
        chosen = words.filter(~rare & (F.col("word") != _START)).select("word").toArrow()["word"].to_numpy()
        vocabulary = np.sort(chosen.view(np.uint64))
        named = F.when(rare, F.lit(_UNKNOWN).cast("long")).otherwise(F.col("word")).alias("word")
        words = words.groupBy(named).agg(*[F.sum(c).alias(c) for c in _WORD_SUMS])
    shared = spark.sparkContext.broadcast(vocabulary)

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts, target in _portions(batch):
                now = _known(words, shared.value)
                before, side = _before(now, counts), np.repeat(target, counts)
                _, first, at, n = np.unique(_pair_keys(before, now), return_index=True, return_inverse=True, return_counts=True)
                n_target = np.bincount(at, side, len(n)).astype(np.int64)
                # Neighbours that share their first word make the shuffled rows compress well.
                order = np.argsort(before[first])
                # A portion has fewer than 2**31 words; both counts are one number on the way.
                both = n[order].astype(np.int64) << 31 | n_target[order]
                columns = [signed(before[first][order]), signed(now[first][order]), both]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["before", "now", "n"])

    pairs = rows.mapInArrow(pair_counts, "before long, now long, n long").repartition("before", "now")
    counts = {"target": F.col("n").bitwiseAND(F.lit((1 << 31) - 1)), "background": F.shiftright("n", 31)}
    pairs = pairs.groupBy("before", "now").agg(*[F.sum(c).alias(s) for s, c in counts.items()])
    pairs = stage(pairs.filter(F.col("background") >= max(float(MIN_PAIR), pair_share * tokens)), "pairs")
    held = pairs.groupBy(F.col("before").alias("word")).agg(*[F.sum(F.greatest(F.col(s) - DISCOUNT, F.lit(0.0))).alias(f"held_{s}") for s in SIDES])
    sums = words.agg(
        *[F.sum(f"now_{s}").alias(s) for s in SIDES], F.count(F.when(~F.col("word").isin(_START, _UNKNOWN), 1)).alias("size")
    ).first()
    single, left = {}, {}
    for s in SIDES:
        # Words of the vocabulary and the unknown word; none is impossible.
        single[s] = ((F.col(f"now_{s}") + 1) / ((sums[s] or 0) + sums["size"] + 1)).alias(f"single_{s}")
        share = F.coalesce(f"held_{s}", F.lit(0.0)) / F.greatest(f"before_{s}", F.lit(1))
        left[s] = F.greatest(1 - share, F.lit(1e-9)).alias(f"left_{s}")
    # Staged, so that the joins with pairs take it straight from an exchange and split hot words.
    parts = stage(words.join(held, "word", "left").select("word", *_WORD_SUMS, *single.values(), *left.values()), "words")
    own = parts.filter(F.col("word") == _UNKNOWN).first()
    unknown = {f"single_{s}": own[f"single_{s}"] if own else 1 / ((sums[s] or 0) + sums["size"] + 1) for s in SIDES}
    unknown |= {f"left_{s}": own[f"left_{s}"] if own else 1.0 for s in SIDES}
    firsts = parts.select(F.col("word").alias("before"), *[f"{c}_{s}" for c in ("before", "left") for s in SIDES])
    seconds = parts.select(F.col("word").alias("now"), *[f"single_{s}" for s in SIDES])
    of_pairs = pairs.join(firsts, "before").join(seconds, "now").mapInArrow(_pair_terms, _TERMS)
    terms = stage(parts.mapInArrow(_word_terms(unknown), _TERMS).unionByName(of_pairs), "terms")
    for table in (counts_table, pairs, parts):
        discard(table)
    # Grades rise with the logarithm of a term's count: a few hundred rows.
    near, least = 0, None
    for r in sorted(terms.groupBy("grade").count().collect(), reverse=True):
        near += r["count"]
        if near > near_terms:
            break
        least = r["grade"]
    is_near = F.lit(False) if least is None else F.col("grade") >= least
    table = terms.filter(is_near).toArrow()  # at most near_terms rows
    order = np.argsort(table["key"].to_numpy().view(np.uint64))
    values = np.stack([table[s].to_numpy()[order] for s in SIDES])
    return Model(terms.filter(~is_near).select("key", *SIDES), table["key"].to_numpy().view(np.uint64)[order], values, unknown, vocabulary)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, difference.

    Losses are nats per token over the whole text; a negative difference means that the
    text is more like the target.  Texts without words, null or empty, have null losses.
    Other columns are not read.
    """
    spark = docs.sparkSession
    share_code(spark)
    shared = spark.sparkContext.broadcast((model.keys, model.values, model.vocabulary))
    single, left = (np.array([[-np.log(model.unknown[f"{part}_{s}"])] for s in SIDES]) for part in ("single", "left"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # Keys are uniform and far ones not frequent, so that all ranges are of about one size.
    ranges = max(spark.sparkContext.defaultParallelism, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, values, vocabulary = shared.value
        part, number = TaskContext.get().partitionId(), 0

        # Keys are uniform: those with the first bits of a key are few, and stand together.
        shift = np.uint64(64 - max(1, len(near).bit_length()))
        bounds = np.append(0, np.cumsum(np.bincount((near >> shift).astype(np.int64), minlength=1 << (64 - int(shift)))))

        def lookup(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first = (keys >> shift).astype(np.int64)
            place, stop = bounds[first], bounds[first + 1]
            known, found = np.zeros(len(keys), bool), np.zeros((2, len(keys)))
            left = np.flatnonzero(place < stop)
            while len(left):
                hit = near[place[left]] == keys[left]
                known[left[hit]] = True
                left = left[~hit]
                place[left] += 1
                left = left[place[left] < stop[left]]
            found[:, known] = values[:, place[known]]
            return known, found

        def ask(ids: pa.Array, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            sizes, totals, texts, keys, n = (np.concatenate(x, axis=-1) for x in zip(*held))
            mark = int(signed(np.bitwise_xor.reduce(mix(keys + texts.astype(np.uint64)), keepdims=True))[0])
            of = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(of, kind="stable")  # texts stay in order
            of = of[order]
            edges = np.flatnonzero(np.diff(of, prepend=-1))
            asked = [_binary(x, edges) for x in (keys[order], texts[order].astype(np.int32), n[order].astype(np.int32))]
            whole = [ids, *(pa.array(x) for x in (sizes, *totals))]
            head = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in whole]
            for at, cells, left, right in (
                (of[edges], np.diff(edges, append=len(of)), asked, [pa.nulls(len(edges), x.type) for x in head]),
                (np.array([(part + number) % ranges]), np.array([len(keys)]), [pa.nulls(1, pa.binary())] * 3, head),
            ):
                names = [np.full(len(at), x, kind) for x, kind in ((part, np.int32), (number, np.int64), (mark, np.int64))]
                columns = [at.astype(np.int32), *names, cells.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *left, *right], names=[*_OF, "keys", "texts", "n", *_HEAD])

        for batch in batches:
            held, size, start = [], 0, 0
            for first, counts, found in hashed_words(batch.column("text"), Alphabet.alphanumeric()):
                now = _known(found, vocabulary)
                before = _before(now, counts)
                text = np.repeat(np.arange(len(counts)), counts)
                # All words as unknown ones, and what known terms change.
                total = (single + left) * counts
                words, at = np.unique(np.append(now, np.uint64(_START)), return_inverse=True)
                starts = at[-1]
                at = at[:-1]
                at_before = _before(at, counts, starts)
                pairs, at_pair = np.unique(_pair_keys(before, now), return_inverse=True)
                far = []
                for keys, place in ((_now_keys(words), at), (_before_keys(words), at_before), (pairs, at_pair)):
                    known, found_values = lookup(keys)
                    total += np.stack([np.bincount(text, v[place], len(counts)) for v in found_values])
                    other = ~known[place]
                    cells, n = np.unique(text[other] * max(len(keys), 1) + place[other], return_counts=True)
                    far.append((cells // max(len(keys), 1), keys[cells % max(len(keys), 1)], n))
                of, keys, n = map(np.concatenate, zip(*far))
                order = np.argsort(of, kind="stable")
                held.append((counts.astype(np.int64), total, first - start + of[order], keys[order], n[order]))
                size += len(keys)
                stop = first + len(counts)
                if size >= PORTION // 2:
                    yield from ask(batch.column("doc_id").slice(start, stop - start), held)
                    held, size, start, number = [], 0, stop, number + 1
            if held:
                yield from ask(batch.column("doc_id").slice(start), held)
                number += 1

    def answers(asked: pa.Table, terms: pa.Table) -> pa.Table:
        """Heads as they are, and sums for each text of each question."""
        if not asked.num_rows:
            return _answer(asked, [None] * 3)
        order = np.argsort(found := terms["key"].to_numpy().view(np.uint64))
        found = np.append(found[order], np.uint64(0))  # never empty
        values = [np.append(terms[s].to_numpy()[order], np.float32(0)).astype(np.float64) for s in SIDES]
        keys, texts, n = (_numbers(asked[c], kind) for c, kind in (("keys", np.uint64), ("texts", np.int32), ("n", np.int32)))
        lengths = np.where(asked["keys"].is_valid().to_numpy(), asked["cells"].to_numpy(), 0)
        question = np.repeat(np.arange(len(lengths)), lengths)
        place = np.minimum(np.searchsorted(found[:-1], keys), max(len(found) - 2, 0))
        known = (found[place] == keys) & (len(found) > 1)
        cells = (question << 32 | texts)[known]
        firsts = np.flatnonzero(np.diff(cells, prepend=-1))
        sums = [np.add.reduceat((v[place] * n)[known], firsts) if len(firsts) else np.zeros(0) for v in values]
        edges = np.searchsorted(cells[firsts] >> 32, np.arange(len(lengths)))
        return _answer(asked, [_binary(x, edges) for x in (cells[firsts].astype(np.int32), *sums)])

    def losses(portion: pa.Table) -> pa.Table:
        heads = portion.filter(pc.is_valid(portion["ids"]))
        asked = portion.filter(pc.is_null(portion["ids"]))
        if heads.num_rows != 1 or heads["cells"][0].as_py() != (pc.sum(asked["cells"]).as_py() or 0):
            raise ValueError("rows of docs came in another order when a lost task was repeated; write docs to a table first")
        ids, sizes, *totals = (heads[c].combine_chunks().flatten() for c in ("ids", "sizes", *SIDES))
        sizes, texts = sizes.to_numpy(), _numbers(asked["texts"], np.int32)
        sums = [t.to_numpy() + np.bincount(texts, _numbers(asked[f"sum_{s}"], np.float64), len(sizes)) for t, s in zip(totals, SIDES)]
        target, background = (x / np.maximum(sizes, 1) for x in sums)
        columns = [pa.array(x, mask=sizes == 0) for x in (target, background, target - background)]
        return pa.Table.from_arrays([ids, pa.array(sizes), *columns], names=_LOSSES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    of = "range int, part int, number long, mark long, cells long"
    head = f"ids array<{kind}>, sizes array<long>, target array<double>, background array<double>"
    asked = rows.mapInArrow(questions, f"{of}, keys binary, texts binary, n binary, {head}")
    of_key = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(ranges), 32).cast("int").alias("range")
    terms = model.far.select(of_key, "key", *SIDES)
    answered = asked.groupBy("range").cogroup(terms.groupBy("range")).applyInArrow(
        answers, f"{of}, texts binary, sum_target binary, sum_background binary, {head}"
    )
    values = ", ".join(f"{c} double" for c in _LOSSES[2:])
    return answered.groupBy("part", "number", "mark").applyInArrow(losses, f"doc_id {kind}, n_tokens long, {values}")


_LOSSES = ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"]
#: Range of keys, portion of the texts, and how many far terms; the mark tells portions of other rows apart.
_OF = ["range", "part", "number", "mark", "cells"]
_HEAD = ["ids", "sizes", *SIDES]


def _binary(x: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of ``x``, cut where ``edges`` say."""
    offsets = np.append(edges, len(x)) * x.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(x)]).cast(pa.binary())


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """What ``_binary`` cut, in one piece."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _answer(asked: pa.Table, columns: list) -> pa.Table:
    sums = [pa.nulls(asked.num_rows, pa.binary()) if c is None else c for c in columns]
    return pa.Table.from_arrays([*(asked[c] for c in _OF), *sums, *(asked[c] for c in _HEAD)], names=[*_OF, "texts", "sum_target", "sum_background", *_HEAD])
