"""Column expressions over element text.  All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that Python's str.strip() and str.split() take as space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# Contact patterns, valid both as Java and as RE2 expressions.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
US_PHONE = r"(?:\+?1[-. ]?)?(?:\([2-9][0-9]{2}\) ?|\b[2-9][0-9]{2}[-. ])[0-9]{3}[-. ][0-9]{4}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"
URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"

# Nine frequent words per language.
STOP_WORDS = {
    "deu": ("der", "die", "das", "und", "ist", "nicht", "ein", "mit", "von"),
    "eng": ("the", "and", "of", "to", "is", "that", "for", "with", "was"),
    "fra": ("le", "la", "les", "et", "des", "est", "une", "dans", "pour"),
    "spa": ("el", "los", "las", "que", "es", "una", "por", "con", "para"),
}


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def present(col: Column) -> Column:
    """True for text that is neither NULL nor blank."""
    return F.coalesce(strip(col) != "", F.lit(False))


def truthy_text(col: Column) -> Column:
    """The text, with the empty string turned into NULL."""
    return F.nullif(col, F.lit(""))


def truthy_number(col: Column) -> Column:
    """The number, with zero turned into NULL."""
    return F.when(col != 0, col)


def truthy_array(col: Column) -> Column:
    """The array, with the empty array turned into NULL."""
    return F.when(F.size(col) > 0, col)


# Words where all white space beyond ASCII has become blanks; single characters make a
# class that is one table lookup per character.
_ASCII_WORD = r"[^\t\n\x0b\f\r\x1c\x1d\x1e\x1f ]+"
_WIDE_SPACES = [c for c in WHITESPACE if ord(c) > 127]


def _ascii_spaces(col: Column) -> Column:
    out = col
    for char in _WIDE_SPACES:
        out = F.replace(out, F.lit(char), F.lit(" "))
    # Pure ASCII text has as many bytes as characters and needs no replacement.
    return F.when(F.octet_length(col) > F.length(col), out).otherwise(col)


def words_of(col: Column) -> Column:
    return F.regexp_extract_all(_ascii_spaces(col), F.lit(_ASCII_WORD), F.lit(0))


def word_count(col: Column) -> Column:
    return F.regexp_count(_ascii_spaces(col), F.lit(_ASCII_WORD))


def sentence_marks(col: Column) -> Column:
    rest = col
    for mark in ".!?":
        rest = F.replace(rest, F.lit(mark), F.lit(""))
    return F.length(col) - F.length(rest)


def clean_whitespace(col: Column) -> Column:
    """No-break spaces and newlines to spaces, runs of spaces to one, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(col, "\u00a0\n", "  "), " {2,}", " "))


def join_broken_paragraphs(col: Column) -> Column:
    """Single newlines inside a paragraph become spaces; paragraphs stay apart."""
    return F.array_join(
        F.transform(F.split(col, r"\n\s*\n"), lambda p: F.translate(p, "\n", " ")), "\n\n"
    )


def language_of(text: Column, stop_words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The code whose stop words occur most often; ties by code, ``und`` without a hit.

    The word lists are a handful of literals, so they are searched for in place: one pass
    over the text, no token rows, no join and no shuffle.
    """
    lists = STOP_WORDS if stop_words is None else stop_words
    words = sorted({w for ws in lists.values() for w in ws})
    whole_word = f"(?<![a-zà-ÿ])(?:{'|'.join(words)})(?![a-zà-ÿ])"
    found = F.regexp_extract_all(F.lower(text), F.lit(whole_word), F.lit(0))

    def score(hits: Column, code: str) -> Column:
        number = F.size(F.filter(hits, lambda w: w.isin(*lists[code])))
        return F.struct(number.alias("hits"), F.lit(code).alias("code"))

    # A lambda over a one-element array binds the hits, so that the text is read once.
    scores = F.transform(F.array(found), lambda hits: F.array(*[score(hits, c) for c in sorted(lists)]))
    # Scores stand in the order of their codes, so the first of the best wins a tie.
    best = F.transform(
        scores,
        lambda s: F.reduce(s, s[0], lambda a, b: F.when(b["hits"] > a["hits"], b).otherwise(a)),
    )[0]
    return F.when(best["hits"] > 0, best["code"]).otherwise("und")


def table_csv(col: Column) -> Column:
    """Cells split at white space and joined by commas, line by line, unquoted."""
    lines = F.transform(F.split(strip(col), "\n"), lambda line: F.array_join(words_of(line), ","))
    return F.when(present(col), F.array_join(F.filter(lines, lambda x: x != ""), "\n"))
