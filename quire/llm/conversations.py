"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

A repaired conversation's roles follow ``(s?(ua)+)?`` by their initials.  Each turn is
kept, given another role or deleted, and empty turns are inserted, at the lowest cost; of
equal costs the ASCII-least string of edits wins.

The pattern's four places are the grammar's: a nonterminal (p, q) derives what leads from
place p to place q, its rules in Chomsky normal form are (p, q) -> (p, r) (r, q) for every
place r, or one turn.  A cell holds the least (cost, audit) of each nonterminal over a
span of turns, with insertions closed in on both sides.  Cells are combined bottom-up by
span length.  As the nonterminals cover all places, a cell comes out the same wherever
its span is cut (audits of equal cost over one span are never prefixes of each other, so
their order survives joining), and one cut, in the middle, is enough: n - 1 combinations
in place of n**3.

Spans of at most ``SPAN`` turns are parsed where sorted ranges put them, so a conversation
of any length is parsed by many tasks.  Texts take no part in that.  The repaired turns
are then read in order, one after the other, by a task that holds one audit and no texts;
their digest can be computed in no other way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.joins import one_per_key
from quire.llm.stage import stage
from quire.session import share_code

SPAN = 4096
#: Characters that are no text.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}

Entry = tuple[int, str] | None
Cell = list[Entry]

#: Places: 0 the start, 1 after s, 2 after u, 3 after a.  Which letter leads where.
PLACES = 4
STEPS = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (3, "u", 2), (2, "a", 3))
NONTERMINALS = [(p, q) for p in range(PLACES) for q in range(PLACES) if q == p or (q > 0 and (p, q) not in ((2, 1), (3, 1)))]
_AT = {pair: k for k, pair in enumerate(NONTERMINALS)}
_RULES = [[(_AT[p, r], _AT[r, q]) for r in range(PLACES) if (p, r) in _AT and (r, q) in _AT] for p, q in NONTERMINALS]
_INSERTED = {(0, 2): "I", (0, 3): "II", (1, 2): "I", (1, 3): "II", (2, 3): "I", (3, 2): "I"}
#: The cell of no turns: insertions only.
EMPTY: Cell = [(INSERT * len(a), a) if (a := "" if p == q else _INSERTED.get((p, q))) is not None else None for p, q in NONTERMINALS]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = []
    for rules in _RULES:
        cost, best = None, None
        for a, b in rules:
            x, y = left[a], right[b]
            if x is None or y is None:
                continue
            total = x[0] + y[0]
            if cost is None or total < cost:
                cost, best = total, x[1] + y[1]
            elif total == cost:
                best = min(best, x[1] + y[1])
        out.append(None if cost is None else (cost, best))
    return out


def _closed(direct: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return combine(combine(EMPTY, [direct.get(pair) for pair in NONTERMINALS]), EMPTY)


@lru_cache(maxsize=256)
def deleted_cell(turns: int) -> Cell:
    """The cell of turns that all have to go."""
    return _closed({(p, p): (DELETE * turns, "D" * turns) for p in range(PLACES)})


@lru_cache(maxsize=256)
def turn_cell(initial: str, cut_off: bool) -> Cell:
    """The cell of one turn that may stay."""
    direct = {(p, p): (DELETE, "D") for p in range(PLACES)}
    for p, letter, q in STEPS:
        if letter != "s":
            direct[p, q] = (REROLE + CUT_OFF * cut_off, "R")
        if letter == initial:
            direct[p, q] = (CUT_OFF * cut_off, "K")
    return _closed(direct)


def span_cell(cells: list[Cell]) -> Cell:
    """The cell of consecutive spans, combined by length."""
    while len(cells) > 1:
        paired = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = paired + cells[2 * len(paired) :]
    return cells[0] if cells else EMPTY


def verdict(cell: Cell) -> tuple[int, str]:
    """Least cost and its edits for whole conversations: they end at the start or after a."""
    return min(e for q in (0, 3) if (e := cell[_AT[0, q]]) is not None)


def damage(rows: DataFrame) -> DataFrame:
    """The turns with faults put in, chosen by a hash of conversation and turn.

    ``copies`` is how often a row stands in the table now, 0 for dropped ones.  Null
    conversations and turns count as one space in the hash.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))), F.lit(20))
    text, role = part("text"), part("role")
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _turns(rows: DataFrame) -> DataFrame:
    """Turns without texts: equal ones of a place in one row, with their first faults."""
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    turns = rows.select(
        "conv_id",
        "turn",
        "role",
        F.md5("text").alias("digest"),
        (shown == "").alias("blank"),
        (~F.substring(shown, -1, 1).isin(*ENDS)).alias("cut_off"),
        "copies",
    )
    runs = turns.groupBy("conv_id", "turn", "role", "digest", "blank", "cut_off").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = one_per_key(runs.filter("copies > 0"), ["conv_id", "role", "digest"], F.min(place).alias("first")).select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    first = F.coalesce(F.col("first").eqNullSafe(place), F.lit(False)).alias("first")
    return runs.join(firsts, same, "left").select("conv_id", "turn", "role", "digest", "blank", "cut_off", "copies", first)


_ORDER = ("conv_id", "turn", "role", "digest")
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_SPAN_TYPES = {c: pa.int64() for c in _COUNTS}
_SPAN_TYPES |= {"low": pa.int64(), "high": pa.int64(), "before": pa.string(), "after": pa.string()}
_SPAN_TYPES |= {"costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
_SPAN_SCHEMA = ", ".join(
    [f"`{c}` long" for c in _COUNTS] + ["low long", "high long", "before string", "after string", "costs array<long>", "audits array<string>"]
)


def _initial(role: str) -> str:
    return role[:1]


def _span(runs: list[dict]) -> dict:
    """Counts and cell of some consecutive turns of one conversation."""
    out = dict.fromkeys(_COUNTS, 0) | {"low": None, "high": None, "before": None, "after": None}
    parsed: list[Cell] = []
    for run in runs:
        n, initial, turn = run["copies"], _initial(run["role"]), run["turn"]
        if not n:
            continue
        out["rows"] += n
        out["illegal"] += n - 1 + (out["after"] is not None and out["after"] + initial not in LEGAL)
        out["before"], out["after"] = initial if out["before"] is None else out["before"], initial
        if turn is not None:
            out["turns"] += out["high"] is None or out["high"] != turn
            out["low"], out["high"] = turn if out["low"] is None else out["low"], turn
        stays = run["first"] and not run["blank"]
        out["blank"] += n if run["blank"] else 0
        out["duplicate"] += 0 if run["blank"] else n - run["first"]
        if stays:
            out["truncated"] += run["cut_off"]
            parsed.append(turn_cell(initial, run["cut_off"]))
            n -= 1
        if n:
            parsed.append(deleted_cell(n))
    cell = span_cell(parsed)
    return out | {"costs": [e and e[0] for e in cell], "audits": [e and e[1] for e in cell]}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        names = batch.schema.names
        for values in zip(*columns):
            yield dict(zip(names, values))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, place = TaskContext.get().partitionId(), 0
    kind = None

    def spans(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict]]:
        for conv, runs in groupby(_rows(rows), lambda r: r["conv_id"]):
            held: list[dict] = []
            for run in runs:
                held.append(run)
                if len(held) == SPAN:
                    yield conv, _span(held)
                    held = []
            if held:
                yield conv, _span(held)

    def typed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in rows:
            kind = batch.schema.field("conv_id").type
            yield batch

    def packed(found: list[tuple[object, dict]]) -> pa.RecordBatch:
        nonlocal place
        arrays = [pa.array([c for c, _ in found], kind), pa.array([part] * len(found), pa.int64()), pa.array(range(place, place + len(found)), pa.int64())]
        arrays += [pa.array([s[c] for _, s in found], t) for c, t in _SPAN_TYPES.items()]
        place += len(found)
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "part", "place", *_SPAN_TYPES])

    found: list[tuple[object, dict]] = []
    size = 0
    for conv, span in spans(typed(batches)):
        found.append((conv, span))
        size += 200 + span["rows"] * len(NONTERMINALS)
        if size > 4 << 20:
            yield packed(found)
            found, size = [], 0
    if found:
        yield packed(found)


class _Conversation:
    """Spans of one conversation, put together in order."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.after = None
        # Only what leads on from the start is needed here.
        self.row: Cell = [EMPTY[_AT[0, q]] for q in range(PLACES)]

    def add(self, span: dict) -> None:
        if not span["rows"]:
            return
        for c in _COUNTS:
            self.counts[c] += span[c]
        self.counts["illegal"] += self.after is not None and self.after + span["before"] not in LEGAL
        self.after = span["after"]
        if span["low"] is not None:
            self.counts["turns"] -= self.high == span["low"]
            self.low, self.high = span["low"] if self.low is None else self.low, span["high"]
        row: Cell = []
        for q in range(PLACES):
            ways = []
            for p in range(PLACES):
                k = _AT.get((p, q))
                if k is not None and self.row[p] is not None and span["costs"][k] is not None:
                    ways.append((self.row[p][0] + span["costs"][k], p, span["audits"][k]))
            least = min((w[0] for w in ways), default=None)
            row.append(None if least is None else (least, min(self.row[p][1] + a for c, p, a in ways if c == least)))
        self.row = row

    def summary(self) -> dict:
        cost, audit = min(e for e in (self.row[0], self.row[3]) if e is not None)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return {**self.counts, "gaps": gaps, "cost": cost, "audit": audit}


def edited(audit: str, rows: Iterable[tuple[object, str, str, int]]) -> Iterator[tuple[str, object, str, str]]:
    """(edit, turn, role, text) of the repaired turns, from (turn, role, text, copies) in order."""
    kept = len(audit) - audit.count("D")
    # An odd number of turns opens with a system turn, which is always a kept one.
    roles = chain([""] * (kept % 2), (("user", "assistant")[k % 2] for k in range(kept)))
    at = 0

    def inserted() -> Iterator[tuple[str, object, str, str]]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield "I", None, next(roles), ""

    for turn, role, text, copies in rows:
        for _ in range(copies):
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                due = next(roles)
                yield edit, turn, role if edit == "K" else due, text
    yield from inserted()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict, Iterator[tuple[str, object, str, str]]]]:
    """Each conversation: its summary, and its repaired turns, to be read before the next."""
    for conv, rows in groupby(_rows(batches), lambda r: r["conv_id"]):
        whole, ahead = _Conversation(), None
        for row in rows:
            if row["span"] is None:
                ahead = row
                break
            whole.add(row["span"])
        summary = whole.summary()
        turns = chain([ahead] if ahead else [], rows)
        yield conv, summary, edited(summary["audit"], ((r["turn"], r["role"], r["text"], r["copies"]) for r in turns))


_SUMMARY = ("rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds: list[pa.DataType] = []

    def typed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds[:] = [batch.schema.field("conv_id").type]
            yield batch

    def packed(found: list[tuple[object, dict, str]]) -> pa.RecordBatch:
        arrays = [pa.array([c for c, _, _ in found], kinds[0])]
        arrays += [pa.array([s[c] for _, s, _ in found], pa.int64()) for c in _SUMMARY]
        arrays += [pa.array([s["audit"] for _, s, _ in found], pa.string()), pa.array([d for _, _, d in found], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *_SUMMARY, "audit", "repaired_sha256"])

    found: list[tuple[object, dict, str]] = []
    size = 0
    for conv, summary, turns in _conversations(typed()):
        digest = hashlib.sha256()
        for k, (_, _, role, text) in enumerate(turns):
            digest.update(("\n" if k else "").encode() + f"{role}:{text}".encode())
        found.append((conv, summary, digest.hexdigest()))
        size += 200 + len(summary["audit"])
        if size > 4 << 20:
            yield packed(found)
            found, size = [], 0
    if found:
        yield packed(found)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds: list[pa.DataType] = []

    def typed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds[:] = [batch.schema.field(c).type for c in ("conv_id", "turn")]
            yield batch

    def packed(found: list[tuple]) -> pa.RecordBatch:
        types = [kinds[0], pa.int64(), pa.string(), kinds[1], pa.string(), pa.string()]
        names = ["conv_id", "place", "edit", "turn", "role", "text"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], names=names)

    found, size = [], 0
    for conv, _, turns in _conversations(typed()):
        for place, turn in enumerate(turns):
            found.append((conv, place, *turn))
            size += 200 + len(turn[3])
            if size > 4 << 20:
                yield packed(found)
                found, size = [], 0
    if found:
        yield packed(found)


def _in_order(rows: DataFrame) -> DataFrame:
    """Spans, then turns, of each conversation in order; a conversation in one partition."""
    spark = rows.sparkSession
    share_code(spark)
    conv = rows.schema["conv_id"].dataType.simpleString()
    turns = stage(_turns(rows), "turns")
    # Ranges, not conversations, are the tasks' shares, so that a long one is split.
    ranges = turns.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    spans = ranges.mapInArrow(_spans, f"conv_id {conv}, part long, place long, {_SPAN_SCHEMA}")
    turn_type = rows.schema["turn"].dataType
    no = lambda kind: F.lit(None).cast(kind)
    heads = spans.select(
        "conv_id", "part", "place", no(turn_type).alias("turn"), no("string").alias("role"), no("string").alias("digest"),
        no("string").alias("text"), no("int").alias("copies"), F.struct(*_SPAN_TYPES).alias("span"),
    )
    # Blank turns are deleted, so their texts stay behind.
    shown = F.when(F.rtrim(F.col("text"), F.lit(BLANKS)) != "", F.col("text")).otherwise("")
    bodies = rows.filter("copies > 0").select(
        "conv_id", no("long").alias("part"), no("long").alias("place"), "turn", "role", F.md5("text").alias("digest"),
        shown.alias("text"), "copies", no(heads.schema["span"].dataType).alias("span"),
    )
    both = heads.union(bodies).withColumn("later", F.col("span").isNull())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "later", "part", "place", "turn", "role", "digest").drop("later")


def _checked(rows: DataFrame) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).alias("copies")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role"), part("text"), copies)


def repair_audit(rows: DataFrame) -> DataFrame:
    """One row for each conv_id: faults, cost, audit and digest of the repaired turns.

    ``rows`` have conv_id, turn, role, text, and may have ``copies`` as ``damage`` gives
    them; a conversation whose rows all have 0 copies is an empty one.  Null roles and
    texts count as one space.  Turns are read in the order of their numbers, null first;
    equal numbers by role, then by the md5 of the text; repeated rows are duplicates.
    Null is a conversation like any other, an empty table has none.  Other columns are
    not read.
    """
    rows = _checked(rows)
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, " + ", ".join(f"`{c}` long" for c in _SUMMARY) + ", audit string, repaired_sha256 string"
    return _in_order(rows).mapInArrow(_digests, schema)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place, edit (K, R or I), turn, role, text.

    Conversations of which nothing stays have no rows; otherwise as ``repair_audit``.
    """
    rows = _checked(rows)
    conv = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows).mapInArrow(_repaired, f"conv_id {conv}, place long, edit string, turn long, role string, text string")
