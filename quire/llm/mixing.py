"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: the sources share all words by weight; a target stops at three times its
source's size, and the excess is shared again by weight until none is above.

Lines: a source's documents stand in a seeded order on one line of words.  Rows fall into
bins by a hash; a bin's place on its source's line is a running sum over blocks of bins,
a row's place in its bin a short window, so no task sees a whole source.

Blocks: a line is cut into blocks of ``block_words`` words, and all words of the mix are
that many blocks.  The sources get them by highest quotients of target / (2 blocks + 1).
The blocks of a source that are no full passes over its line are shared among the shards
of the line, runs of ``SHARD_BLOCKS`` blocks, by highest quotients again, so every shard
has its integer quota before any block is chosen.  A shard takes its blocks in a seeded
order.  Where a line's length is no multiple of a block, the words left over after full
passes and whole blocks come from the first shard's next block.  A source's words are
within two blocks of its target; one that is at its limit meets it.

The last winning quotient of the sources is searched by repeated aggregates, the shards'
quotas have a closed form, as all shards but the last are equal: nothing is ranked in one
task but the few quotients next to the last winner.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.ordered import running_sum
from quire.llm.stage import stage

WEIGHTS = (1.0, 2.0, 3.0)
BLOCK_WORDS = 64
SHARD_BLOCKS = 16
BIN_ROWS = 2_000
LIMIT = 3
SEED = 20
#: Candidates for the last winning quotient that one aggregate tries.
_TRIES = 31


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Add ``name``: each row's place in the order, from 1, which no single task works out."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = stage(ranged, "numbered")
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    # One row for each range partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select("__part", (F.sum("__rows").over(before) - F.col("__rows")).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__place", place).join(starts, "__part").withColumn(name, F.col("__start") + F.col("__place")).drop("__part", "__place", "__start")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, ...) with weight and target, one row per source.

    Sources in code point order, null last, take the weights in turn.  The factor that
    turns weights into words rises with each round of capped sources until no target is
    above its limit; a round is one aggregate, and only its two sums come to the driver.
    """
    placed = numbered(sizes, "place", F.col("source").isNull(), F.col("source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stage(placed.withColumn("weight", turn).withColumn("top", F.col("source_size") * float(limit)), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    factor, capped = 0.0, -1
    while True:
        over = F.col("weight") * factor >= F.col("top")
        free = table.agg(
            F.sum(F.when(over, F.col("top")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(over.cast("int")).alias("capped"),
        ).first()
        if not free["weight"] or free["capped"] == capped:
            break
        capped, factor = free["capped"], (total - free["taken"]) / free["weight"]
    return table.withColumn("target", F.least(F.col("weight") * factor, F.col("top"))).drop("top")


def sainte_lague(parties: DataFrame, key: str, weight: str, seats: int, name: str) -> DataFrame:
    """Add ``name``: the seats of each party when ``seats`` go to the highest quotients.

    A party of weight w has floor(w f + 1/2) seats where quotients from 1 / (2 f) on win.
    Each aggregate tries several f between one that gives too few seats and one that gives
    enough, until hardly any quotient is left between them or those left are equal; they
    are put in order, ties by the smaller ``key``.  Parties without weight get no seat.
    """
    w = F.coalesce(F.when(F.col(weight) > 0, F.col(weight)), F.lit(0.0))
    won = lambda f: F.floor(w * F.lit(f) + 0.5)
    total = parties.agg(F.sum(w).alias("w"), F.count_if(w > 0).alias("n")).first()
    if not total["w"] or seats <= 0:
        return parties.withColumn(name, F.lit(0).cast("long"))
    low, high = 0.0, (seats + total["n"]) / total["w"] * (1 + 1e-9)
    given, enough = 0, None
    while given < seats:
        step = (high - low) / (_TRIES + 1)
        tries = sorted({low + k * step for k in range(1, _TRIES + 1)} - {low, high})
        if not tries or enough is not None and enough - given <= 1:
            break
        sums = parties.agg(*[F.sum(won(f)).alias(f"f{k}") for k, f in enumerate(tries)], F.sum(won(high)).alias("high")).first()
        found = [(low, given), *zip(tries, sums[:-1]), (high, sums[-1])]
        low, given = max((x for x in found if x[1] <= seats), key=lambda x: (x[1], x[0]))
        high, enough = min((x for x in found if x[1] > given and x[0] > low), default=(high, given))
    first = parties.withColumn(name, won(low).cast("long"))
    if given == seats:
        return first
    # The quotients between both: at most one if they can be told apart, else equal ones.
    more = (won(high) - F.col(name)).cast("long")
    rivals = first.filter(more > 0).select(F.col(key).alias("__key"), w.alias("__w"), F.explode(F.sequence(F.col(name), F.col(name) + more - 1)).alias("__k"))
    quotient = F.col("__w") / (2 * F.col("__k") + 1)
    placed = numbered(rivals.withColumn("__q", -quotient), "__at", F.col("__q"), F.col("__key").isNull(), F.col("__key"), F.col("__k"))
    extra = placed.filter(F.col("__at") <= seats - given).groupBy("__key").agg(F.count(F.lit(1)).alias("__more"))
    joined = first.join(extra, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.withColumn(name, F.col(name) + F.coalesce("__more", F.lit(0))).drop("__key", "__more")


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def shard_quota(shard: Column, blocks: Column, seats: Column, per_shard: int = SHARD_BLOCKS) -> Column:
    """Seats of one shard when the ``seats`` of a line of ``blocks`` go to highest quotients.

    Shards are runs of ``per_shard`` blocks, and a shard's weight is its blocks, so all but
    the last are equal: they are served in turns of all of them, in the order of their
    numbers, and between two turns the last, smaller one is served at most once.
    """
    full = _div(blocks, per_shard)
    rest = blocks - full * per_shard
    # After ``a`` turns the last shard has as many seats as odd numbers up to this.
    reached = lambda a: F.when(a > 0, _div(_div(rest * (2 * a - 1), per_shard) + 1, 2)).otherwise(F.lit(0).cast("long"))
    # Those that it gets before the next turn, not in a tie with it.
    ahead = lambda a: F.when(rest > 0, _div(_div(rest * (2 * a + 1) - 1, per_shard) + 1, 2)).otherwise(F.lit(0).cast("long"))
    total = lambda a: full * a + reached(a)
    guess = F.greatest(_div(seats * per_shard, F.greatest(blocks, F.lit(1))) - 1, F.lit(0))
    turns = F.array_max(F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: guess + k), lambda a: (total(a) <= seats) | (a == 0)))

    def quota(a: Column) -> Column:
        over = seats - total(a)
        early = F.least(over, ahead(a) - reached(a))
        in_turn = F.least(over - early, full)
        last = reached(a) + early + (over - early - in_turn)
        return F.when(full == 0, F.when(shard == 0, seats).otherwise(0)).when(shard < full, a + (shard < in_turn).cast("long")).otherwise(last)

    return F.get(F.transform(F.array(turns), quota), F.lit(0))


def _chosen(seed: int, block_words: int, per_shard: int) -> Column:
    """Ranges of a row's own words that its source's chosen blocks cover, in order.

    Needs party, source_size, blocks, quota_blocks, rest_words, start and size.
    """
    start, size = F.col("start"), F.col("size")
    first, last = _div(start, block_words), _div(start + size - 1, block_words)

    def of_shard(shard: Column) -> Column:
        begin = shard * per_shard
        end = F.least(begin + per_shard, F.col("blocks"))
        drawn = F.array_sort(F.transform(F.sequence(begin, end - 1), lambda b: F.struct(F.xxhash64("party", b, F.lit(seed)).alias("h"), b.alias("b"))))
        quota = shard_quota(shard, F.col("blocks"), F.col("quota_blocks"), per_shard)
        spare = F.when(shard == 0, F.col("rest_words")).otherwise(0)

        def cover(x: Column, k: Column) -> Column:
            at = x["b"] * block_words
            words = F.when(k < quota, F.lit(block_words)).when(k == quota, spare).otherwise(0)
            until = F.least(at + words, F.col("source_size"))
            return F.struct(F.least(F.greatest(at - start, F.lit(0)), size).alias("first"), F.least(F.greatest(until - start, F.lit(0)), size).alias("last"))

        return F.transform(drawn, cover)

    shards = F.sequence(_div(first, per_shard), _div(last, per_shard))
    found = F.filter(F.flatten(F.transform(shards, of_shard)), lambda r: r["last"] > r["first"])
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    some = (size > 0) & ((F.col("quota_blocks") > 0) | (F.col("rest_words") > 0))
    return F.when(some, F.array_sort(found.cast("array<struct<first:bigint,last:bigint>>"))).otherwise(none)


def plan_mix(
    docs: DataFrame,
    keep: list[Column],
    weights: Sequence[float] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    bin_rows: int = BIN_ROWS,
    seed: int = SEED,
    shard_blocks: int = SHARD_BLOCKS,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of ``keep``) and what the mix takes of it.

    size, source_size and target are in words; passes is the number of whole repeats, and
    ranges are the words (from, up to) that the chosen blocks cover besides, in order.
    taken counts all words.  A source takes whole blocks, and no more than three times its
    size.  Null and wordless texts have size 0 and give nothing; a null source is a source
    of its own.  Rows that repeat an id are placed one by one.  An empty table gives an
    empty result; other columns are not read.
    """
    bins = max(1, -(-docs.count() // bin_rows))
    # A name without null, so that the line and the join share one exchange.
    party = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("party")
    crc = F.crc32(F.col("text").cast("string"))
    rows = docs.select(
        F.struct(*keep).alias("row"), party, word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", crc, F.lit(seed)).alias("draw")
    ).withColumn("bin", F.pmod("draw", F.lit(bins)).cast("int"))
    sums = stage(rows.groupBy("party", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    named = F.when(F.col("party") != "", F.substr("party", F.lit(2))).alias("source")
    sizes = sums.groupBy("party").agg(F.sum("bin_size").alias("source_size")).select("party", named, "source_size")
    targets = stage(source_targets(sizes, weights), "targets")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    shared = sainte_lague(targets, "source", "target", round(total / block_words), "seats")
    top = F.col("source_size") * LIMIT
    # A source at its limit is taken whole each time; the others take whole blocks.
    words = F.when(F.col("target") >= top, top).otherwise(F.least(F.col("seats") * block_words, top))
    line = F.greatest(F.col("source_size"), F.lit(1))
    over = words - _div(words, line) * line
    quotas = shared.select(
        "party",
        "source_size",
        "target",
        _div(words, line).alias("passes"),
        F.ceil(F.col("source_size") / block_words).alias("blocks"),
        _div(over, block_words).alias("quota_blocks"),
        (over - _div(over, block_words) * block_words).alias("rest_words"),
    )
    offsets = running_sum(sums, ["party"], "bin", F.col("bin_size"), "offset", inclusive=False).drop("bin_size")
    before = Window.partitionBy("party", "bin").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("before", F.sum("size").over(before) - F.col("size"))
    return (
        placed.join(offsets.join(stage(quotas, "quotas"), "party"), ["party", "bin"])
        .withColumn("start", F.col("offset") + F.col("before"))
        .select(
            "row",
            "size",
            "source_size",
            "target",
            F.when(F.col("size") > 0, F.col("passes")).otherwise(0).alias("passes"),
            _chosen(seed, block_words, shard_blocks).alias("ranges"),
        )
        .withColumn("taken", F.col("passes") * F.col("size") + _words(F.col("ranges")))
    )


def _words(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as it is taken whole, and its cut pass.

    A cut pass holds the words of the chosen blocks, joined by single spaces, if they are
    not all of the text's.  Columns stay as they are; an ``n_chars`` column follows a cut
    text.
    """
    plan = plan_mix(docs, [F.col(f"`{c}`") for c in docs.columns], **options).withColumn("cut", _words(F.col("ranges")))
    times = F.col("passes") + (F.col("cut") > 0).cast("long")
    each = plan.withColumn("pass", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))))
    partial = (F.col("pass") > F.col("passes")) & (F.col("cut") < F.col("size"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"([^\x20\x09-\x0D]+)"))
    pieces = _let(words, lambda w: F.flatten(F.transform("ranges", lambda r: F.slice(w, (r["first"] + 1).cast("int"), (r["last"] - r["first"]).cast("int")))))
    text = F.when(partial, F.array_join(pieces, " ")).otherwise(F.col("row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(partial, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return each.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
