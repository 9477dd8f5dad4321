"""Words of UTF-8 texts as 64-bit hashes, computed over arrays of bytes.

Texts are taken whole, in groups of about ``BLOCK`` bytes, so that the working arrays stay
small; a longer text is cut at separators and its words are put together again, which
costs eight bytes a word.  A word's hash depends on its bytes alone, so equal words have
equal hashes in every task and every run.  Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose result looks random in every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed long."""
    return h.view(np.int64)


class Alphabet:
    """Which bytes belong to words.

    ``kinds`` gives each byte a kind: 0 for separators; a word is a longest run of bytes
    of one other kind.  A-Z count as a-z, unless ``fold`` is off.
    """

    def __init__(self, kinds: np.ndarray, fold: bool = True) -> None:
        self.kinds = kinds.astype(np.uint8)
        folded = np.arange(256)
        if fold:
            folded[65:91] += 32
        self.codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))[folded]

    @staticmethod
    def unspaced(fold: bool = True) -> Alphabet:
        """Words ``[^\\x20\\x09-\\x0D]+``."""
        kinds = np.ones(256)
        kinds[[0x20, *range(0x09, 0x0E)]] = 0
        return Alphabet(kinds, fold)

    @staticmethod
    def alphanumeric() -> Alphabet:
        """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
        kinds = np.zeros(256)
        for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
            kinds[low:high] = 1
        return Alphabet(kinds)

    @staticmethod
    def letters() -> Alphabet:
        """Words ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
        kinds = np.zeros(256)
        for low, high in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
            kinds[low:high] = 1
        return Alphabet(kinds)

    @staticmethod
    def words_and_marks() -> Alphabet:
        """Runs of letters and digits, and runs of other visible bytes."""
        kinds = Alphabet.alphanumeric().kinds.astype(float)
        kinds[0x21:0x7F] = np.where(kinds[0x21:0x7F] == 0, 2, 1)
        return Alphabet(kinds)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def _spans(data: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in ``data``, where they start and where they end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = alphabet.kinds[data]
    edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    starts = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [len(data)]))
    words = kinds[starts] > 0
    starts, ends = starts[words], ends[words]
    up, down = _powers(max(len(data), BLOCK))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(alphabet.codes[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def _cuts(data: np.ndarray, alphabet: Alphabet) -> Iterator[np.ndarray]:
    """One long text in pieces that end at separators."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(alphabet.kinds[data[at:end]] == 0)
            while not len(gaps) and end < len(data):  # one word longer than a block
                more = min(end + BLOCK, len(data))
                gaps = np.flatnonzero(alphabet.kinds[data[end:more]] == 0) + (end - at)
                end = more
            if len(gaps) and end < len(data):
                end = at + int(gaps[-1]) + 1
        yield data[at:end]
        at = end


def placed_words(
    texts: pa.Array | pa.ChunkedArray, alphabet: Alphabet
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of consecutive texts: the first one's index, words per text, their hashes, the
    bytes they stand in, their starts and their ends.  A long text is several groups.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(raw):
        return
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(raw):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1
        if last <= first:
            for piece in _cuts(data[offsets[first] : offsets[first + 1]], alphabet):
                hashes, starts, ends = _spans(piece, alphabet)
                yield first, np.array([len(hashes)]), hashes, piece, starts, ends
            first += 1
            continue
        last = min(last, len(raw))
        # A separator after every text keeps words of neighbours apart.
        lengths = np.diff(offsets[first : last + 1])
        bounds = np.cumsum(lengths + 1)
        joined = np.full(int(bounds[-1]), 0x0A, np.uint8)
        inside = np.ones(len(joined), bool)
        inside[bounds - 1] = False
        joined[inside] = data[offsets[first] : offsets[last]]
        hashes, starts, ends = _spans(joined, alphabet)
        at = np.searchsorted(starts, np.concatenate(([0], bounds)))
        yield first, np.diff(at), hashes, joined, starts, ends
        first = last


def hashed_words(
    texts: pa.Array | pa.ChunkedArray, alphabet: Alphabet
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of consecutive texts: the first one's index, words per text, word hashes.

    Unlike in ``placed_words``, a long text is one group.
    """
    held: list[np.ndarray] = []
    at = -1
    for first, counts, hashes, *_ in placed_words(texts, alphabet):
        if held and first != at:
            words = np.concatenate(held)
            yield at, np.array([len(words)]), words
            held = []
        if len(counts) == 1:
            at = first
            held.append(hashes)
        else:
            yield first, counts, hashes
    if held:
        words = np.concatenate(held)
        yield at, np.array([len(words)]), words


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words, also across texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total *= np.uint64(_ODD)
        total += words[j : j + n]
    return mix(total + np.uint64(size))


def text_windows(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``size`` words inside one text: their hashes, first words and texts."""
    text = np.repeat(np.arange(len(counts)), counts)
    found = windows(words, size)
    whole = np.flatnonzero(text[: len(found)] == text[size - 1 : size - 1 + len(found)])
    return found[whole], whole, text[whole]
