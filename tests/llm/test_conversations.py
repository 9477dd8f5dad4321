"""Conversation repair: cells against all cuts and all edits, damage and digests by rule."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import conversations as cv
from quire.llm.conversations import combine, damage, deleted_cell, edited, repair, repair_audit, span_cell, turn_cell, verdict
from quire.llm.oracle import REPAIR

SHAPE = re.compile(r"(s?(ua)+)?")


def all_edits(turns):
    """The least (cost, edits) by trying everything; a turn is (initial, cut off) or None."""

    @lru_cache(maxsize=None)
    def best(at, out):
        found = [(0, "")] if at == len(turns) and SHAPE.fullmatch(out) else []
        ways = [(3, "D", at + 1, out)] if at < len(turns) else []
        if at < len(turns) and turns[at]:
            initial, cut = turns[at]
            ways += [(cut, "K", at + 1, out + initial), (2 + cut, "R", at + 1, out + "u"), (2 + cut, "R", at + 1, out + "a")]
        if len(out) <= len(turns) + 2:
            ways += [(2, "I", at, out + "u"), (2, "I", at, out + "a")]
        for cost, edit, then, now in ways:
            # Only beginnings of the pattern are worth following.
            if re.fullmatch(r"s?(ua)*u?", now):
                rest = best(then, now)
                if rest:
                    found.append((cost + rest[0], edit + rest[1]))
        return min(found, default=None)

    return best(0, "")


def cell_of(turn):
    return turn_cell(*turn) if turn else deleted_cell(1)


def test_cells_equal_all_edits():
    rng = random.Random(1)
    for _ in range(400):
        turns = tuple(rng.choice([None, *[(i, c) for i in ("s", "u", "a", "x", "") for c in (False, True)]]) for _ in range(rng.randint(0, 6)))
        turns = tuple(t and (t[0] or "-", t[1]) for t in turns)
        assert verdict(span_cell([cell_of(t) for t in turns])) == all_edits(turns)


def test_every_cut_gives_the_same_cell():
    rng = random.Random(2)
    turns = [rng.choice([None, ("s", False), ("u", False), ("u", True), ("a", False), ("a", True), ("?", False)]) for _ in range(14)]
    cells = {(i, i + 1): cell_of(t) for i, t in enumerate(turns)}
    for length in range(2, len(turns) + 1):
        for i in range(len(turns) - length + 1):
            ways = [combine(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)]
            assert all(w == ways[0] for w in ways)
            cells[i, i + length] = ways[0]
    assert cells[0, len(turns)] == span_cell([cell_of(t) for t in turns])


def test_a_run_of_deletions_is_one_cell():
    assert deleted_cell(5) == span_cell([deleted_cell(1)] * 5)


def test_edits_are_carried_out():
    rows = [(1, "system", "be brief", 1), (2, "assistant", "hello", 1), (2, "assistant", "hello", 1), (4, "tool", "x", 1)]
    done = list(edited("KIKDRI", rows))
    assert [(e, r, t) for e, _, r, t in done] == [
        ("K", "system", "be brief"), ("I", "user", ""), ("K", "assistant", "hello"), ("R", "user", "x"), ("I", "assistant", ""),
    ]


def test_damage_by_rule(spark):
    rows = [(c, t, r, f"One. Two! {t}?") for c in [None, *range(40)] for t, r in [(None, "user"), (0, "system"), (1, "user"), (2, None)]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["turn"]): (r["role"], r["text"], r["copies"]) for r in damage(table).collect()}
    kinds = set()
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        kinds.add(fault)
        role = "user" if fault == 4 else role or " "
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        assert found[c, t] == (role, text, {0: 0, 3: 2}.get(fault, 1))
    assert {0, 1, 2, 3, 4} <= kinds


ROWS = [
    (1, 0, "user", "Hello there."), (1, 1, "assistant", "Hi."), (1, 2, "user", "And"), (1, 4, "user", "Hello there."),
    (2, None, "user", "no number."), (2, None, "user", None), (2, 3, None, "odd."), (2, 3, "", "empty role!"), (2, 9, "assistant", "ok?\n"),
    (None, 1, "assistant", "lost."), (None, 2, "user", "Why?"),
    (3, 5, "user", " \t "), (3, 6, "assistant", "fin"),
    (4, 0, "system", "s."), (4, 0, "system", "s."), (4, 0, "system", "s."), (4, 1, "ural", "kept as u."), (4, 2, "assistant", "done."),
    (5, 0, "user", ""), (5, 1, "user", " \n"),
]


@pytest.fixture(scope="module")
def many():
    rng = random.Random(7)
    said = ["Yes.", "No!", "Perhaps", "", "What? ", "so\n", "Grüße."]
    out = list(ROWS)
    for c in range(10, 60):
        out += [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(said)) for _ in range(rng.randint(1, 14))]
    return out + [(99, k, ("user", "assistant")[k % 2], f"turn {k}." if k % 7 else "again.") for k in range(300)]


@pytest.mark.parametrize("span", [cv.SPAN, 3])
def test_audit_equals_sql(spark, many, span, monkeypatch):
    monkeypatch.setattr(cv, "SPAN", span)
    schema = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame(many, schema).select("*", *[F.lit("own").alias(c) for c in ("copies", "span", "part", "place", "digest", "audit")])
    found = repair_audit(damage(table)).drop("rows")
    con = duckdb.connect()
    frame = spark.createDataFrame(many, schema).toArrow()
    con.register("conversations", frame)
    relation = con.sql(REPAIR)
    assert relation.columns == found.columns
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(relation.fetchall(), key=key)


def test_repaired_turns_follow_the_pattern(spark, many):
    table = spark.createDataFrame(many, "conv_id long, turn long, role string, text string")
    turns = {}
    for r in sorted(repair(table).collect(), key=lambda r: r["place"]):
        turns.setdefault(r["conv_id"], []).append(r)
    audits = {r["conv_id"]: r for r in repair_audit(table).collect()}
    assert set(audits) == {r[0] for r in many}
    for conv, audit in audits.items():
        rows = turns.get(conv, [])
        assert SHAPE.fullmatch("".join(r["role"][:1] for r in rows))
        assert [r["edit"] for r in rows] == [e for e in audit["audit"] if e != "D"]
        assert audit["repaired_sha256"] == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in rows).encode()).hexdigest()
    assert [(r["role"], r["text"]) for r in turns[4]] == [("system", "s."), ("ural", "kept as u."), ("assistant", "done.")]
    assert 5 not in turns and audits[5]["audit"] == "DD" and audits[5]["cost"] == 6


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string, copies int"
    assert repair_audit(spark.createDataFrame([], schema)).count() == 0
    [row] = repair_audit(spark.createDataFrame([(1, 0, "user", "Hi.", 0)], schema)).collect()
    assert row["audit"] == "" and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert {row[c] for c in ("rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")} == {0}


def test_very_long_texts(spark):
    long = "word " * 60_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long + " " * 60_000)]
    [row] = repair_audit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert (row["audit"], row["cost"], row["duplicate"]) == ("KKKI", 2, 0)
