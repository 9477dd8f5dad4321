"""Near-duplicate documents by HyperMinHash sketches, confirmed on full shingle sets.

A sketch has 128 buckets.  The top bits of a shingle's hash name the bucket, and of the
smallest remaining hash in a bucket only the count of leading zeros and ten following
bits are kept, 16 bits in all (Yu and Weber, HyperMinHash, 2017).  Four registers make a
band; an empty bucket borrows the register of another one, found by a fixed order of
tries, so that small sets have full bands as well.  Documents that share a band are
candidates.  A pair is dropped early only if its sizes exclude the threshold or its
estimated similarity, corrected for chance equality of registers, lies six standard
deviations below it; the others are compared on their full sets.

Groups of copies do not become pairs.  Documents with equal sets are one class from the
start.  In a band's bucket every member is compared with one leader, the member that
meets most others in its buckets, which joins most copies to one component.  Members of
buckets that still hold several components are compared across components, by an exact
prefix filter on their sets: shingles are ordered by how many of these members hold
them, rare ones first, and two sets that meet the threshold share one of the first
``n - ceil(t n) + 1``.  Edits make rare shingles, so a copy that is linked with nobody has
a prefix that is its own and meets nobody.  Where much boilerplate is shared, whole
prefixes may meet many others; so the members of a crowded shingle meet only by (shingle,
own size band, other size band), and a member is put there only if its shingle comes early
enough for a partner of that size: what both sets still hold from it on must suffice.  Documents that share too
little then meet nobody, however many they are.  No link between different components that
a band has found is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.joins import one_per_key
from quire.llm.components import connected
from quire.llm.stage import stage
from quire.llm.words import Alphabet, hashed_words, mix, signed, text_windows, windows
from quire.session import share_code

SHINGLE = 5
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
BAND = 4
_TRIES = 64
_EMPTY = 0
#: Shingles in more prefixes than this are met by bands, whose sizes differ by this factor.
CROWD = 64
SIZE_BAND = 1.01

SKETCHES = "doc_id long, n_shingles long, set_a long, set_b long, registers array<smallint>"
SETS = "set_a long, set_b long, shingles array<bigint>"


def _borrow_order() -> np.ndarray:
    """For each bucket, the buckets to try when it is empty, by a fixed rule."""
    cells = np.arange(BUCKETS * _TRIES, dtype=np.uint64) + np.uint64(1)
    return (mix(cells) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64).reshape(BUCKETS, _TRIES)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; fewer than five words are one shingle."""
    for _, counts, words in hashed_words(texts, Alphabet.unspaced()):
        found, _, owner = text_windows(words, counts, SHINGLE)
        cuts = np.searchsorted(owner, np.arange(len(counts) + 1))
        ends = np.cumsum(counts)
        for k, n in enumerate(counts):
            if n >= SHINGLE:
                yield np.unique(found[cuts[k] : cuts[k + 1]])
            else:
                yield windows(words[ends[k] - n : ends[k]], int(n)) if n else np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set: (leading zeros + 1) and mantissa; 0 for empty buckets."""
    out = np.zeros(BUCKETS, np.uint16)
    if not len(shingles):
        return out
    bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = shingles[first] << np.uint64(BUCKET_BITS)  # sorted: the first one is the smallest
    zeros = np.zeros(len(rest), np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        low = rest < np.uint64(1 << (64 - step))
        zeros[low] += np.uint64(step)
        rest = np.where(low, rest << np.uint64(step), rest)
    mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa
    return out


def band_keys(sketch: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One key for each band of a non-empty sketch, empty buckets filled by borrowing."""
    full = np.flatnonzero(sketch)
    empty = np.flatnonzero(sketch == 0)
    if len(empty):
        filled = sketch.copy()
        tries = sketch[order[empty]]
        chosen = tries[np.arange(len(empty)), (tries > 0).argmax(1)]
        after = full[np.searchsorted(full, empty) % len(full)]
        filled[empty] = np.where(chosen > 0, chosen, sketch[after])
        sketch = filled
    lanes = np.ascontiguousarray(sketch).view(np.uint64)
    return mix(lanes ^ mix(np.arange(1, len(lanes) + 1, dtype=np.uint64)))


def _digest(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two hashes of 64 bits of a set, whatever the order of its members."""
    a = np.sum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return a, np.sum(mix(shingles + np.uint64(0x14057B7EF767814F)), dtype=np.uint64)


def _digest_columns(digests: list[tuple[np.uint64, np.uint64]]) -> list[pa.Array]:
    both = np.array(digests, np.uint64).reshape(-1, 2)
    return [pa.array(signed(np.ascontiguousarray(both[:, k]))) for k in (0, 1)]


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # One set after the other: what is kept of it is small.
        n, digests, kept = [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            digests.append(_digest(s))
            kept.append(registers(s).view(np.int16))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n, pa.int64()),
                *_digest_columns(digests),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(kept) + 1, dtype=np.int32) * BUCKETS),
                    pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int16)),
                ),
            ],
            names=["doc_id", "n_shingles", "set_a", "set_b", "registers"],
        )


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = _borrow_order()
    for batch in batches:
        sketches = [x.values.to_numpy().view(np.uint16) for x in batch.column("registers")]
        keys = [band_keys(x, order) for x in sketches]
        size = BUCKETS // BAND
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(np.concatenate(keys)) if keys else [], pa.int64()),
                pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), size), pa.int64()),
            ],
            names=["band", "node"],
        )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        values = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [*_digest_columns([_digest(s) for s in sets]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
            names=["set_a", "set_b", "shingles"],
        )


def estimated_similarity(a: Column, b: Column, n_a: Column, n_b: Column) -> tuple[Column, Column]:
    """Jaccard estimate from two register arrays, and the number of occupied buckets.

    Unlike minima agree by chance in about 0.17 / 2**MANTISSA of the buckets for sets of
    like size (the constant is the paper's); that many are taken off the agreements.
    """
    both = F.zip_with(a, b, lambda x, y: F.when((x == y) & (x != _EMPTY), 1).otherwise(0))
    used = F.zip_with(a, b, lambda x, y: F.when((x != _EMPTY) | (y != _EMPTY), 1).otherwise(0))
    add = lambda total, x: total + x
    agree, occupied = F.aggregate(both, F.lit(0), add), F.aggregate(used, F.lit(0), add)
    alike = 4.0 * n_a * n_b / ((n_a + n_b) * (n_a + n_b))
    chance = 0.169919487159739 * occupied / (1 << MANTISSA) * alike
    return (agree - chance) / occupied, occupied


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): set size, 128-bit digest of the set and sketch."""
    share_code(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketch_batches, SKETCHES)


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose full sets meet the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("common", common)
        .filter(100 * F.col("common") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("common")))
        .select("a", "b")
    )


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _leader_pairs(active: DataFrame) -> DataFrame:
    """Each member (band, node, n) of the buckets with its bucket's leader.

    The leader is the node whose buckets are largest together, the smallest one of equals.
    """
    weight = active.groupBy("node").agg(F.sum("n").alias("weight"))
    weighted = active.join(weight, "node")
    leaders = one_per_key(weighted, ["band"], F.max_by("node", F.struct("weight", -F.col("node"))).alias("leader"))
    return weighted.join(leaders, "band").filter("node <> leader").select(*_pair("node", "leader")).distinct()


def _rooted(nodes: DataFrame, component: DataFrame, node: str, root: str) -> DataFrame:
    known = component.select(F.col("node").alias(node), F.col("component").alias("__c"))
    return nodes.join(known, node, "left").withColumn(root, F.coalesce("__c", node)).drop("__c")


def _mixed_nodes(active: DataFrame, component: DataFrame) -> DataFrame:
    """(node, root) of the members of buckets that hold several components."""
    known = _rooted(active.select("band", "node"), component, "node", "root")
    several = one_per_key(known, ["band"], F.min("root").alias("low"), F.max("root").alias("high"))
    return known.join(several.filter("low < high").select("band"), "band").select("node", "root").distinct()


def _meetings(mixed: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Two nodes of different components for each shingle of both prefixes in a pair of bands."""
    shingles = sets.join(mixed, "node")
    length = F.size("shingles") - F.ceil(F.size("shingles") * similarity / 100) + 1
    each = shingles.select("node", "root", F.size("shingles").alias("size"), length.alias("prefix"), F.explode("shingles").alias("shingle"))
    held = one_per_key(each, ["shingle"], F.count(F.lit(1)).alias("held")).filter("held > 1")
    common = each.join(held, "shingle")
    own = Window.partitionBy("node")
    # Shingles of one node alone come first and meet nobody: they only use up the prefix.
    alone = F.col("size") - F.count(F.lit(1)).over(own)
    place = F.row_number().over(own.orderBy("held", "shingle"))
    first = common.withColumn("place", place + alone).filter("place <= prefix").select("shingle", "node", "root", "size", "place")
    several = one_per_key(first, ["shingle"], F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("crowd")).filter("low < high")
    met = stage(first.join(several.select("shingle", "crowd"), "shingle"), "prefixes")
    columns = ("node", "root", "size", "place")
    second = [F.col(c).alias(f"{c}_b") for c in columns]
    few = met.filter(F.col("crowd") <= CROWD).select("shingle", *columns)
    many = stage(_by_bands(met.filter(F.col("crowd") > CROWD).select("shingle", *columns), similarity), "bands")
    others = many.select("shingle", F.col("partner").alias("band"), F.col("band").alias("partner"), *second)
    meetings = [
        few.join(few.select("shingle", *second), "shingle").drop("shingle"),
        many.join(others, ["shingle", "band", "partner"]).drop("shingle", "band", "partner"),
    ]
    return meetings[0].unionByName(meetings[1]).filter("root < root_b")


def _prefix_pairs(mixed: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs of nodes from different components that share a shingle of both prefixes."""
    # Sizes must fit, and what both hold from this shingle on must still suffice.
    left = 1 + F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    fits = (
        F.expr(f"100 * least(size, size_b) >= {similarity} * greatest(size, size_b)")
        & ((100 + similarity) * left >= similarity * (F.col("size") + F.col("size_b")))
    )
    return _meetings(mixed, sets, similarity).filter(fits).select(*_pair("node", "node_b")).distinct()


def _by_bands(first: DataFrame, similarity: int) -> DataFrame:
    """Rows of prefixes, once for each band of sizes in which they can have a partner.

    A partner of a band has its smallest size at least, and the sizes' ratio is bounded;
    a row whose shingle comes too late even for such a partner is not put there.
    """
    t = similarity / 100
    band = lambda x: F.floor(F.log(x.cast("double")) / float(np.log(SIZE_BAND))).cast("int")
    size = F.col("size")
    bands = F.sequence(band(size * t) - 1, band(size / t) + 1)

    def smallest(h: Column) -> Column:
        # One less than the band's lowest size, for rounding.
        return F.greatest(F.floor(F.pow(F.lit(SIZE_BAND), h.cast("double"))) - 1, F.ceil(size * t))

    suffices = lambda h: (100 + similarity) * (1 + size - F.col("place")) >= similarity * (size + smallest(h))
    return first.withColumn("band", band(size)).withColumn("partner", F.explode(F.filter(bands, suffices)))


def _likely(pairs: DataFrame, sketch: DataFrame, similarity: int) -> DataFrame:
    """Pairs that their sizes and their sketches leave possible."""
    side = lambda x: sketch.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.filter(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    estimate, occupied = estimated_similarity(F.col("r_a"), F.col("r_b"), F.col("n_a"), F.col("n_b"))
    t = similarity / 100
    return sized.filter(estimate >= t - 6 * F.sqrt(t * (1 - t) / occupied)).select("a", "b", "n_a", "n_b")


def near_duplicates(docs: DataFrame, similarity: int = 75) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if ``100 * intersection >= similarity * union`` of their shingle
    sets.  component_id is the smallest doc_id reachable over links, kept tells whether
    it is the row's own.  Null and wordless texts have no shingles and are linked with
    nothing.  Rows without doc_id cannot be named by a link; they are kept and have no
    component_id.  Rows that share a doc_id are compared each by its own text.  An empty
    table gives an empty result; other columns are not read.
    """
    rows = stage(sketches(docs), "sketches")
    named = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class of equal sets is a node; its number is fixed when the table is written.
    firsts = F.struct("doc_id", F.col("n_shingles"), "registers")
    classes = one_per_key(named, ["set_a", "set_b"], F.min_by(firsts, "doc_id").alias("head"))
    heads = stage(classes.select("set_a", "set_b", "head.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    bands = stage(heads.select("node", "registers").mapInArrow(_band_batches, "band long, node long"), "bands")
    shared = one_per_key(bands, ["band"], F.count(F.lit(1)).alias("n")).filter("n > 1")
    active = stage(bands.join(shared, "band"), "buckets")
    nodes = active.select("node").distinct()
    sketch = stage(heads.join(nodes, "node"), "candidates")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sketch.select("doc_id").distinct(), "doc_id")
    found = texts.select("text").mapInArrow(_set_batches, SETS).join(sketch.select("set_a", "set_b", "node"), ["set_a", "set_b"])
    sets = stage(found.select("node", "shingles").dropDuplicates(["node"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = stage(_likely(pairs, sketch, similarity), "pairs")
        return stage(_confirmed(likely, sets, similarity), "links")

    component = connected(confirmed(_leader_pairs(active)))
    mixed = stage(_mixed_nodes(active, component), "mixed")
    more = confirmed(_prefix_pairs(mixed, sets, similarity))
    between = _rooted(_rooted(more, component, "a", "x"), component, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = connected(between)

    known = heads.select("set_a", "set_b", "node", F.col("doc_id").alias("first"))
    reached = stage(_rooted(_rooted(known, component, "node", "middle"), merged, "middle", "root"), "roots")
    smallest = one_per_key(reached, ["root"], F.min("first").alias("component_id"))
    component_of = reached.join(smallest, "root").select("set_a", "set_b", "component_id")
    # Rows without a set or an id meet no class.
    none = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    lone = rows.filter(none).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    in_class = rows.filter(~none).join(component_of, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    return in_class.unionByName(lone).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, similarity: int = 75) -> DataFrame:
    """The rows of ``docs`` but for those whose doc_id is not the first of its component."""
    gone = near_duplicates(docs, similarity).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
