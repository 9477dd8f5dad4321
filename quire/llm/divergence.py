"""How the sources of a language differ in their use of words.

A language keeps the terms that stand in at least ``MIN_DOCS`` of its documents.  Kept
terms are sorted over ranges, and every range becomes a minimal acyclic transducer
(``transducer.py``) that gives a term its ordinal: the number of its range and its place
there, so ordinals are in the terms' UTF-8 order.  The texts are streamed through the
transducers a second time to count kept terms by source.

The transducers of a pass are broadcast.  A pass takes ranges of at most ``PASS_BYTES``;
a larger vocabulary takes more passes over the texts, each written before the next.
Terms are counted inside tasks, over arrays, before they are shuffled: equal terms are
found by two hashes of 64 bits.  Sources are compared block by block of ordinals, and
tile by tile of sources, so neither a large vocabulary nor many sources meet in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.stage import stage
from quire.llm.transducer import Builder, Transducer
from quire.llm.words import Alphabet, mix, placed_words
from quire.session import share_code

MIN_DOCS = 30
TOP_TERMS = 50
#: Kept terms of one transducer, about; and bytes of transducers broadcast together, but
#: always one transducer.
RANGE_TERMS = 100_000
PASS_BYTES = 64 << 20
#: Terms of a block and sources of a tile in comparisons.
BLOCK_TERMS = 4096
TILE_SOURCES = 128
#: Different counts that a task holds before it passes them on, and rows that it holds
#: before it adds up equal ones.
HELD_COUNTS = 1_000_000
HELD_ROWS = 3_000_000
_ROWS = 100_000
_LETTERS = Alphabet.letters()
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Terms:
    """Strings as runs of one array of bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.data, self.starts, self.lengths = data, starts, lengths

    def __len__(self) -> int:
        return len(self.starts)

    def take(self, index: np.ndarray) -> Terms:
        """The chosen strings in an array of their own."""
        starts, lengths = self.starts[index], self.lengths[index]
        ends = np.cumsum(lengths)
        begins = ends - lengths
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - begins, lengths)
        return Terms(self.data[at], begins, lengths)

    @staticmethod
    def joined(parts: list[Terms]) -> Terms:
        moved = np.cumsum([0, *(len(p.data) for p in parts)])[:-1]
        starts = [p.starts + m for p, m in zip(parts, moved)]
        none = np.zeros(0, np.int64)
        return Terms(
            np.concatenate([np.zeros(0, np.uint8), *(p.data for p in parts)]),
            np.concatenate([none, *starts]),
            np.concatenate([none, *(p.lengths for p in parts)]),
        )

    def hashes(self) -> np.ndarray:
        """Another hash than that of the words, from sums of weighted bytes."""
        ends = np.cumsum(self.lengths)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - self.lengths, self.lengths)
        at = np.repeat(self.starts, self.lengths) + place
        weighted = mix((place.astype(np.uint64) << np.uint64(8)) + self.data[at].astype(np.uint64) + _ODD)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighted)))
        return mix(sums[ends] - sums[ends - self.lengths] + self.lengths.astype(np.uint64))

    def prefixes(self) -> np.ndarray:
        """The first eight bytes as numbers that compare like the strings."""
        at = np.minimum(self.starts[:, None] + np.arange(8), max(len(self.data) - 1, 0))
        inside = np.arange(8) < self.lengths[:, None]
        first = np.where(inside, self.data[at] if len(self.data) else 0, 0).astype(np.uint8)
        return np.ascontiguousarray(first).view(">u8").ravel().astype(np.uint64)

    def arrow(self) -> pa.Array:
        whole = self.take(np.arange(len(self)))
        offsets = np.concatenate((whole.starts, [len(whole.data)])).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(whole), [None, pa.py_buffer(offsets), pa.py_buffer(whole.data.tobytes())])


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with equal keys (of 64 bits, but the last): one row's index; which group each is in."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(new) - 1
    return order[new], groups


class _Names:
    """Numbers for the different keys of a task."""

    def __init__(self) -> None:
        self.names: list = []
        self.numbers: dict = {}

    def of(self, keys: list) -> np.ndarray:
        for k in keys:
            if k not in self.numbers:
                self.numbers[k] = len(self.names)
                self.names.append(k)
        return np.array([self.numbers[k] for k in keys], np.int64)


def _batch_terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, Terms]]:
    """For groups of texts: the text of each word, the word's hash, and the words."""
    for first, counts, hashes, data, starts, ends in placed_words(texts, _LETTERS):
        yield first + np.repeat(np.arange(len(counts)), counts), hashes, Terms(_LOWER[data], starts, ends - starts)


def _slices(n: int) -> Iterator[slice]:
    return (slice(at, at + _ROWS) for at in range(0, n, _ROWS))


class _DocumentCounts:
    """In how many documents of a language a term stands."""

    def __init__(self) -> None:
        self.langs = _Names()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Terms]] = []
        self.rows = 0

    def add(self, langs: list[str], texts: pa.Array) -> None:
        number = self.langs.of(langs)
        held: tuple[int, list] = (-1, [])  # pieces of the text that the last group ends with
        for text, hashes, terms in _batch_terms(texts):
            if not len(text):
                continue
            if held[1] and held[0] == text[0] == text[-1]:
                held[1].append((text, hashes, terms))
                continue
            self._each_once(number, held[1])
            held = (int(text[0]), [(text, hashes, terms)])
        self._each_once(number, held[1])
        if self.rows > HELD_ROWS:
            self.compact()

    def _each_once(self, number: np.ndarray, groups: list) -> None:
        if groups:
            text, hashes = (np.concatenate([g[k] for g in groups]) for k in (0, 1))
            terms = Terms.joined([g[2] for g in groups])
            once, _ = _grouped(hashes, text)
            terms = terms.take(once)
            self.parts.append((number[text[once]], hashes[once], terms.hashes(), np.ones(len(once), np.int64), terms))
            self.rows += len(once)

    def compact(self) -> None:
        if not self.parts:
            return
        lang, first, second, n = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        terms = Terms.joined([p[4] for p in self.parts])
        once, group = _grouped(second, first, lang)
        n = np.bincount(group, n, len(once)).astype(np.int64)
        self.parts = [(lang[once], first[once], second[once], n, terms.take(once))]
        self.rows = len(once)

    def flushed(self) -> Iterator[pa.RecordBatch]:
        self.compact()
        for lang, _, _, n, terms in self.parts:
            names = np.array(self.langs.names, object)
            for part in _slices(len(n)):
                of = np.arange(len(n))[part]
                columns = [pa.array(names[lang[part]], pa.string()), terms.take(of).arrow(), pa.array(n[part])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "n"])
        self.__init__()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _DocumentCounts()
    for batch in batches:
        counts.add(batch.column("lang").to_pylist(), batch.column("text"))
        if counts.rows > HELD_COUNTS and len(counts.parts) == 1:
            yield from counts.flushed()
    yield from counts.flushed()


def _plain(docs: DataFrame) -> DataFrame:
    names = ("lang", "source", "text")
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms that stand in at least ``min_docs`` documents of a language."""
    share_code(docs.sparkSession)
    found = _plain(docs).select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


_TABLES = ("keys", "targets", "adds", "final")
_TYPES = (np.int64, np.int32, np.int32, np.uint8)
#: Rows of two kinds: a kept term with its place, and a range's automaton.
_BUILT = "shard long, lang string, place long, term string, langs array<string>, firsts array<binary>, roots array<long>, sizes array<long>, " + ", ".join(f"{c} binary" for c in _TABLES)
_BUILT_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.binary()] * len(_TABLES)
_BUILT_NAMES = ["shard", "lang", "place", "term", "langs", "firsts", "roots", "sizes", *_TABLES]


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId()
    builder, langs, firsts, roots, sizes = Builder(), [], [], [], []

    def row(values: list[list]) -> pa.RecordBatch:
        n = len(values[0])
        columns = [pa.array(v, t) if v is not None else pa.nulls(n, t) for v, t in zip(values, _BUILT_TYPES)]
        return pa.RecordBatch.from_arrays(columns, names=_BUILT_NAMES)

    for batch in batches:
        of, terms = batch.column("lang").to_pylist(), batch.column("term").cast(pa.binary()).to_pylist()
        places = []
        for lang, term in zip(of, terms):
            if not langs or langs[-1] != lang:
                if langs:
                    roots.append(builder.close())
                langs.append(lang)
                firsts.append(term)
                sizes.append(0)
            builder.add(term)
            places.append(sizes[-1])
            sizes[-1] += 1
        yield row([[shard] * len(of), of, places, batch.column("term"), *[None] * 8])
    if langs:
        roots.append(builder.close())
        tables = [[t.astype(kind).tobytes()] for t, kind in zip(builder.tables(), _TYPES)]
        yield row([[shard], None, None, None, [langs], [firsts], [roots], [sizes], *tables])


def transducers(kept: DataFrame, range_terms: int = RANGE_TERMS) -> DataFrame:
    """Sorted kept terms with their places, and for each range of them its automaton."""
    share_code(kept.sparkSession)
    ranges = -(-max(kept.count(), 1) // range_terms)
    ordered = kept.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(_built, _BUILT)


class Vocabulary:
    """The transducers of one pass."""

    def __init__(self, rows: list[dict]) -> None:
        self.languages: dict[str, list[tuple[bytes, int, int, Transducer]]] = defaultdict(list)
        for row in sorted(rows, key=lambda r: r["shard"]):
            found = Transducer(*[np.frombuffer(row[c], kind) for c, kind in zip(_TABLES, _TYPES)])
            for lang, first, root in zip(row["langs"], row["firsts"], row["roots"]):
                self.languages[lang].append((bytes(first), row["shard"], root, found))

    def look_up(self, lang: str, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        """Range and place of each term; places are -1 for terms that are not kept."""
        pieces = self.languages.get(lang, [])
        shard, place = np.zeros(len(terms), np.int64), np.full(len(terms), -1, np.int64)
        if not pieces or not len(terms):
            return shard, place
        firsts = b"".join(p[0] for p in pieces)
        lengths = np.array([len(p[0]) for p in pieces])
        begins = Terms(np.frombuffer(firsts, np.uint8), np.cumsum(lengths) - lengths, lengths).prefixes()
        # Ranges that begin alike for eight bytes are tried one after the other.
        own = terms.prefixes()
        low = np.maximum(np.searchsorted(begins, own, "left") - 1, 0)
        high = np.maximum(np.searchsorted(begins, own, "right") - 1, 0)
        for k in np.unique(np.concatenate((low, high))).tolist() if (high - low <= 1).all() else range(len(pieces)):
            tried = np.flatnonzero((place < 0) & (low <= k) & (k <= high))
            if len(tried):
                _, number, root, transducer = pieces[k]
                place[tried] = transducer.ordinals(root, terms.data, terms.starts[tried], terms.lengths[tried])
                shard[tried] = number
        return shard, place


class _SourceCounts:
    """How often kept terms stand in the texts of a language and source."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.groups = vocabulary, _Names()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: list[tuple[str, str]], texts: pa.Array) -> None:
        number = self.groups.of(keys)
        # A word is looked up once for each language of a group of texts.
        lang_of = np.array([self.groups.numbers[k] for k in keys], np.int64)
        langs = _Names()
        lang = langs.of([k[0] for k in keys])
        for text, hashes, terms in _batch_terms(texts):
            once, same = _grouped(hashes, lang[text])
            shard, place = np.zeros(len(once), np.int64), np.full(len(once), -1, np.int64)
            for k, name in enumerate(langs.names):
                own = np.flatnonzero(lang[text[once]] == k)
                if len(own) and name in self.vocabulary.languages:
                    words = Terms(terms.data, terms.starts[once[own]], terms.lengths[once[own]])
                    shard[own], place[own] = self.vocabulary.look_up(name, words)
            known = np.flatnonzero(place[same] >= 0)
            group, shard, place = lang_of[text[known]], shard[same[known]], place[same[known]]
            rows, of = _grouped(place, shard, group)
            self.parts.append((group[rows], shard[rows], place[rows], np.bincount(of, minlength=len(rows)).astype(np.int64)))
            self.rows += len(rows)
        if self.rows > HELD_ROWS:
            self.compact()

    def compact(self) -> None:
        if self.parts:
            group, shard, place, n = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
            once, of = _grouped(place, shard, group)
            self.parts = [(group[once], shard[once], place[once], np.bincount(of, n, len(once)).astype(np.int64))]
            self.rows = len(once)

    def flushed(self) -> Iterator[pa.RecordBatch]:
        self.compact()
        for group, shard, place, n in self.parts:
            langs, sources = (np.array([k[j] for k in self.groups.names], object) for j in (0, 1))
            for part in _slices(len(n)):
                columns = [pa.array(langs[group[part]], pa.string()), pa.array(sources[group[part]], pa.string())]
                columns += [pa.array(x[part]) for x in (shard, place, n)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "shard", "place", "n"])
        self.__init__(self.vocabulary)


def _recount(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _SourceCounts(Vocabulary(shared.value))
        for batch in rows:
            counts.add(list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())), batch.column("text"))
            if counts.rows > HELD_COUNTS and len(counts.parts) == 1:
                yield from counts.flushed()
        yield from counts.flushed()

    return batches


def recount(docs: DataFrame, built: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(lang, source, shard, place, n): occurrences of kept terms, those that occur."""
    spark = docs.sparkSession
    share_code(spark)
    automata = built.filter(F.col("langs").isNotNull()).select("shard", "langs", "firsts", "roots", *_TABLES)
    size = reduce(lambda a, b: a + b, [F.length(c) for c in _TABLES])
    # One row of two numbers for each range of kept terms.
    sizes = sorted((r["shard"], r["size"]) for r in automata.select("shard", size.alias("size")).collect())
    passes: list[list[int]] = []
    room = 0
    for shard, bytes_ in sizes:
        if bytes_ > room or not passes:
            passes.append([])
            room = pass_bytes
        passes[-1].append(shard)
        room -= bytes_
    schema = "lang string, source string, shard long, place long, n long"
    counted = []
    for shards in passes:
        rows = automata.filter(F.col("shard").between(shards[0], shards[-1])).collect()  # pass_bytes at most, or one range
        shared = spark.sparkContext.broadcast([r.asDict() for r in rows])
        found = _plain(docs).mapInArrow(_recount(shared), schema)
        keys = ("lang", "source", "shard", "place")
        counted.append(stage(found.groupBy(*keys).agg(F.sum("n").alias("n")), "term-counts"))
        shared.unpersist()
    return reduce(DataFrame.union, counted) if counted else spark.createDataFrame([], schema)


def _share(n: Column | str) -> Column:
    """The smoothed share of a term, in units of a thousand-millionth."""
    count = F.col(n) if isinstance(n, str) else n
    scaled = F.lit(1_000_000_000).cast("decimal(20,0)") * (count + 5).cast("decimal(18,0)")
    # A scaled decimal over a long, as a whole number.
    return 1 + F.call_function("div", scaled, (F.col("total") + 5 * F.col("v")).cast("decimal(18,0)"))


def _tile_pairs(key: tuple, rows: pa.Table) -> pa.Table:
    """Summed differences of all pairs of sources that two tiles make, over one block."""
    low, high = key[3].as_py(), key[4].as_py()
    rows = rows.sort_by("source")
    names, tiles = rows.column("source").to_pylist(), np.array(rows.column("tile").to_pylist())
    width = rows.column("width")[0].as_py()
    shares = np.empty((len(names), width), np.int64)
    shares[:] = np.array(rows.column("zero").fill_null(0).to_pylist())[:, None]
    for row, cells in enumerate(rows.column("cells").combine_chunks()):
        if cells.is_valid and len(cells):
            values = cells.values
            shares[row, values.field("place").to_numpy()] = values.field("p").to_numpy()
    a, b, value = [], [], []
    for row in range(len(names)):
        others = np.arange(row + 1, len(names))
        if low != high:
            others = others[tiles[others] != tiles[row]]
        if len(others):
            a += [names[row]] * len(others)
            b += [names[k] for k in others]
            value += np.abs(shares[others] - shares[row]).sum(axis=1).tolist()
    columns = [pa.array([key[0].as_py()] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())]
    return pa.Table.from_arrays(columns, names=["lang", "a", "b", "value"])


def _pairs(groups: DataFrame, shares: DataFrame, pieces: DataFrame, block_terms: int, tile_sources: int) -> DataFrame:
    """(lang, source, item, value) for each source of a language and each other one."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_terms)))
    blocks = pieces.select("lang", "shard", "size", block.alias("block")).select(
        "lang", "shard", "block", F.least(F.lit(block_terms), F.col("size") - F.col("block") * block_terms).cast("int").alias("width")
    )
    inside = F.struct((F.col("place") % block_terms).cast("int").alias("place"), F.col("p"))
    cells = shares.groupBy("lang", "source", "shard", F.floor(F.col("place") / block_terms).alias("block")).agg(F.collect_list(inside).alias("cells"))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile_sources).alias("tiles"))
    # A language without kept terms has one block of no width.
    grid = (
        groups.join(tiles, "lang")
        .withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
        .join(blocks, "lang", "left")
        .withColumn("width", F.coalesce("width", F.lit(0)))
        .join(cells, ["lang", "source", "shard", "block"], "left")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .withColumn("low", F.least("tile", "other"))
        .withColumn("high", F.greatest("tile", "other"))
        .select("lang", "shard", "block", "low", "high", "source", "tile", "zero", "width", "cells")
    )
    parts = grid.groupBy("lang", "shard", "block", "low", "high").applyInArrow(_tile_pairs, "lang string, a string, b string, value long")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return summed.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def source_divergence(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    range_terms: int = RANGE_TERMS,
    pass_bytes: int = PASS_BYTES,
    block_terms: int = BLOCK_TERMS,
    tile_sources: int = TILE_SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources, and their own terms.

    ``pair`` rows hold the summed difference to each other source of the language, ``term``
    rows the terms that a source uses more than its language does.  Null text, language or
    source counts as empty; repeated rows count again; equal values are ranked by their
    items in UTF-8 order, terms by their ordinals.  A language without kept terms has pairs
    of value 0 and no terms, a source alone in its language has no pairs, an empty table
    gives no rows.  Texts are taken whole, in pieces; other columns are not read.
    """
    kept = stage(kept_terms(docs, min_docs), "kept-terms")
    built = stage(transducers(kept, range_terms), "transducers")
    counts = recount(docs, built, pass_bytes)
    ranges = built.filter(F.col("langs").isNotNull())
    pieces = ranges.select("shard", F.explode(F.arrays_zip("langs", "sizes")).alias("piece")).select(
        "shard", F.col("piece.langs").alias("lang"), F.col("piece.sizes").alias("size")
    )
    vocabulary = pieces.groupBy("lang").agg(F.sum("size").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    occurring = _plain(docs).select("lang", "source").distinct()
    # A share of a term that does not occur; null for languages without kept terms.
    groups = (
        occurring.join(vocabulary, "lang", "left")
        .join(totals, ["lang", "source"], "left")
        .withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
        .withColumn("zero", _share(F.lit(0).cast("long")))
    )
    groups = stage(groups, "groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n")).select("lang", "source", "shard", "place", "n", "p")
    pairs = _pairs(groups.select("lang", "source", "zero"), shares, pieces, block_terms, tile_sources)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by_value))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    of_lang = counts.groupBy("lang", "shard", "place").agg(F.sum("n").alias("n")).join(whole, "lang")
    own = (
        shares.join(of_lang.select("lang", "shard", "place", _share("n").alias("q")), ["lang", "shard", "place"])
        .filter("p > q")
        .withColumn("value", F.col("p") - F.col("q"))
    )
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "shard", "place")
    top = own.withColumn("rank", F.row_number().over(by_ordinal)).filter(F.col("rank") <= top_terms)
    terms = built.filter(F.col("term").isNotNull()).select("lang", "shard", "place", "term")
    top = top.join(terms, ["lang", "shard", "place"])
    columns = lambda part, item: ("lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), "value", "rank")
    return ranked.select(*columns("pair", "item")).union(top.select(*columns("term", "term")))
