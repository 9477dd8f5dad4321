"""The transducer against a plain list, and source divergence against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import divergence, words
from quire.llm.divergence import Terms, source_divergence
from quire.llm.transducer import Builder, Transducer


def root_of(builder, terms):
    for term in terms:
        builder.add(term)
    return builder.close()


def ordinals(table, root, terms):
    lengths = np.array([len(t) for t in terms], np.int64)
    data = np.frombuffer(b"".join(terms) + b"\0", np.uint8)
    return table.ordinals(root, data, np.cumsum(lengths) - lengths, lengths).tolist()


def test_ordinals_are_places_in_the_sorted_list():
    rng = random.Random(5)
    letters = ["a", "b", "é", "ß", "字", "z"]
    words = lambda n: sorted({"".join(rng.choices(letters, k=rng.randint(1, 6))).encode() for _ in range(n)})
    lists = [words(500), words(40), [], [b"x"]]
    builder = Builder()
    roots = [root_of(builder, terms) for terms in lists]
    found = Transducer(*builder.tables())
    for root, terms in zip(roots, lists):
        assert ordinals(found, root, terms) == list(range(len(terms)))
        others = [w for w in words(300) if w not in set(terms)] + [b"", b"aaaaaaaaaaaaaaaa"]
        assert set(ordinals(found, root, others)) == {-1}


def _right_languages(table, root):
    arcs = defaultdict(dict)
    for key, target in zip(table.keys.tolist(), table.targets.tolist()):
        arcs[key >> 8][key & 255] = target
    memo = {}

    def of(state):
        if state not in memo:
            own = {b""} if table.final[state] else set()
            memo[state] = frozenset(own | {bytes([b]) + rest for b, t in arcs[state].items() for rest in of(t)})
        return memo[state]

    of(root)
    return memo


def test_the_automaton_is_minimal():
    builder = Builder()
    root = root_of(builder, [b"bake", b"bakes", b"lake", b"lakes", b"make", b"maker", b"makes"])
    memo = _right_languages(Transducer(*builder.tables()), root)
    assert len(set(memo.values())) == len(memo)


@pytest.mark.parametrize("terms", [[b"b", b"a"], [b"a", b"a"], [b""]])
def test_terms_out_of_order(terms):
    with pytest.raises(ValueError):
        root_of(Builder(), terms)


def test_terms_of_long_texts(monkeypatch):
    text = "Straße the END x1y Ünï " * 300
    monkeypatch.setattr(words, "BLOCK", 64)
    found = []
    for _, _, terms in divergence._batch_terms(pa.array([text, None, "", "One TWO", text])):
        found += terms.arrow().to_pylist()
    lower = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate({k: k + 32 for k in range(65, 91)}))
    assert found == lower(text) + ["one", "two"] + lower(text)


def test_strings_as_runs():
    made = ["", "b", "ab", "abcdefgh", "abcdefghi", "ab\u00e9", "zz"]
    lengths = np.array([len(m.encode()) for m in made])
    terms = Terms(np.frombuffer("".join(made).encode(), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert terms.arrow().to_pylist() == made and terms.take(np.array([6, 1, 1])).arrow().to_pylist() == ["zz", "b", "b"]
    both = Terms.joined([terms, terms.take(np.array([2]))])
    assert both.arrow().to_pylist() == [*made, "ab"]
    hashes = both.hashes()
    assert hashes[2] == hashes[-1] and len(set(hashes.tolist())) == len(made)
    prefixes = terms.prefixes()
    assert all((prefixes[i] < prefixes[j]) <= (made[i].encode() < made[j].encode()) for i in range(7) for j in range(7))


def plain(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))) for text, lang, source in rows]
    in_docs = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in in_docs.items():
        if n >= min_docs:
            kept[lang].append(t)
    count, by_lang = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        own = [t for t in terms if t in set(kept[lang])]
        count[lang, source].update(own)
        by_lang[lang].update(own)
    share = lambda c, t, v: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v)
    out = []
    for lang, source in count:
        terms, v = kept[lang], len(kept[lang])
        pairs = [(sum(abs(share(count[lang, source], t, v) - share(count[lang, o], t, v)) for t in terms), o) for k, o in count if k == lang and o != source]
        own = [(share(count[lang, source], t, v) - share(by_lang[lang], t, v), t) for t in terms if count[lang, source][t]]
        for part, found, most in (("pair", pairs, None), ("term", [x for x in own if x[0] > 0], top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gämma", "été", "zeta", "字", "eta", "theta2iota"] + [f"w{chr(97 + k)}" for k in range(26)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(120)]
    out = [(t, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", "ö", None])) for t in texts]
    return out + [(None, "en", "a"), ("", "xx", "a"), ("9 -", "xx", "b"), ("lone", "yy", "q")] + out[:5]


@pytest.mark.parametrize("bounds", [{}, {"range_terms": 4, "pass_bytes": 1, "block_terms": 3, "tile_sources": 2}])
def test_divergence_equals_plain_counting(spark, rows, bounds, monkeypatch):
    if bounds:
        monkeypatch.setattr(divergence, "HELD_ROWS", 50)
        monkeypatch.setattr(divergence, "HELD_COUNTS", 20)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    clash = docs.select("*", *[F.lit("own").alias(c) for c in ("term", "n", "shard", "place", "total", "v", "value", "p")])
    found = source_divergence(clash, min_docs=6, top_terms=4, **bounds)
    assert sorted(map(tuple, found.collect())) == plain(rows, 6, 4)


def test_divergence_of_nothing_and_of_long_texts(spark, none, edges):
    assert source_divergence(none).count() == 0
    # No term stands in 30 documents: pairs of value 0 only.
    found = source_divergence(edges).collect()
    assert {(r["part"], r["value"]) for r in found} == {("pair", 0)}
    both = source_divergence(edges, min_docs=2).filter("part = 'term' AND lang = 'en' AND source = 'c'").collect()
    assert [r["item"] for r in both][0] == "word"
