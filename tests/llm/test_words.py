import re

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from quire.llm.words import Alphabet, hashed_words

PATTERNS = {"unspaced": r"[^\x20\x09-\x0D]+", "alphanumeric": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def hashes(texts, alphabet):
    out = []
    for _, counts, found in hashed_words(pa.array(texts, pa.string()), alphabet):
        at = 0
        for n in counts:
            out.append(found[at : at + n].tolist())
            at += n
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbBé ß\n\t.-9\x0b\x85\xa0", max_size=30)), max_size=8))
def test_equal_words_have_equal_hashes(texts):
    for name, pattern in PATTERNS.items():
        found = hashes(texts, getattr(Alphabet, name)())
        words = [re.findall(pattern, lower(t or "")) for t in texts]
        assert [len(x) for x in found] == [len(x) for x in words]
        seen = {}
        for h, w in zip((h for x in found for h in x), (w for x in words for w in x)):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_long_texts_are_cut_at_separators_only():
    word = "x" * 700_000
    texts = ["ab cd " * 100_000 + "ab", word + " ab", "ab " + word, None, "ab"]
    found = hashes(texts, Alphabet.unspaced())
    ab, cd, x = found[4][0], found[0][1], found[1][0]
    assert found[0] == [ab, cd] * 100_000 + [ab]
    assert found[1] == [x, ab] and found[2] == [ab, x] and found[3] == []
