"""Languages of texts by ranked profiles of character n-grams.

Texts become lower-case letters with single blanks between words; their runs of three
characters fall into ``BUCKETS`` buckets by a plain formula over code points.  A language's
profile ranks its buckets by how often they occur in labelled text; a run scores the more
the higher its bucket ranks, which for word-like frequencies is close to a logarithm of
its probability.  A text's score in a language is the sum over all of its runs, and
probabilities follow from the differences.

Profiles are a few thousand small numbers, four languages packed into one of 64 bits, so a
run costs one array access and the whole works inside the expression: no rows, no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.html import bind

BUCKETS = 4096
#: A rank's score is TOP less its binary logarithm, 0 from rank 2**TOP on.
TOP = 12
#: Runs whose packed scores are added before they are taken apart: TOP * RUNS fits a field.
RUNS = 2048
FIELD, FIELDS = 15, 4
#: From this probability on a language is one of a text's.
SHARE = 0.2
UNKNOWN = "und"
# ISO 639 codes of two and three letters.
CODES = {"de": "deu", "en": "eng", "es": "spa", "fr": "fra", "it": "ita", "nl": "nld", "pl": "pol", "pt": "por"}


def _letters(text: Column) -> Column:
    """Lower-case letters with single blanks between words and around all; NULL text is two blanks."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def _bucket(a: Column, b: Column, c: Column) -> Column:
    """Code points are small enough for 32 bits, and never negative."""
    return (a * 1369 + b * 37 + c).bitwiseAND(F.lit(BUCKETS - 1))


def runs_of(text: Column) -> Column:
    """The bucket of each run of three characters of a text, an array; NULL text has none."""
    points = F.transform(F.split(_letters(text), ""), lambda c: F.ascii(c))

    def buckets(p: Column) -> Column:
        return F.transform(F.slice(p, F.lit(1), F.size(p) - 2), lambda a, i: _bucket(a, F.get(p, i + 1), F.get(p, i + 2)))

    # Two blanks alone are a text without letters.
    return bind(points, lambda p: F.when(F.size(p) > 2, buckets(p)).otherwise(F.array().cast("array<int>")))


@dataclass(frozen=True)
class Profiles:
    """Language codes in order, and for each group of four the packed scores of all buckets."""

    codes: tuple[str, ...]
    tables: tuple[tuple[int, ...], ...]


def rank_profiles(labelled: DataFrame, code: str = "lang", text: str = "text") -> DataFrame:
    """``(code, bucket, score)`` of the ranked buckets of each language, at most 2**TOP of them.

    Runs are counted as strings inside tasks before they are shuffled, and only distinct
    ones are put into buckets, of which a language has at most ``BUCKETS`` to rank; equal
    counts rank by bucket.  Rows without code are left out.
    """
    known = F.coalesce(*[F.when(F.col(code) == k, v) for k, v in CODES.items()], F.col(code).cast("string"))
    # Each character is consumed, and looked at with the two behind it.
    runs = F.regexp_extract_all(_letters(F.col(text)), F.lit("(?=(...))."), F.lit(1))
    each = labelled.filter(F.col(code).isNotNull()).select(known.alias("code"), F.explode(runs).alias("run"))
    found = each.groupBy("code", "run").agg(F.count("*").alias("n"))
    bucket = _bucket(*[F.ascii(F.substring("run", k, 1)) for k in (1, 2, 3)])
    counts = found.groupBy("code", bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "bucket"))
    score = F.greatest(TOP - F.floor(F.log2(rank.cast("double")) + 1e-9), F.lit(0)).cast("int")
    return counts.withColumn("score", score).filter("score > 0").select("code", "bucket", "score")


def train_profiles(labelled: DataFrame, code: str = "lang", text: str = "text") -> Profiles:
    """Profiles of the languages of ``labelled``: ``BUCKETS`` small numbers for each come to the driver."""
    rows = rank_profiles(labelled, code, text).collect()
    codes = tuple(sorted({r["code"] for r in rows}))
    tables = [[0] * BUCKETS for _ in range(-(-len(codes) // FIELDS))]
    for r in rows:
        group, field = divmod(codes.index(r["code"]), FIELDS)
        tables[group][r["bucket"]] |= r["score"] << (FIELD * field)
    return Profiles(codes, tuple(map(tuple, tables)))


def scores_of(text: Column, profiles: Profiles) -> Column:
    """An array with the score of each language, in the order of the codes."""

    def summed(runs: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / RUNS).cast("int")), lambda k: F.slice(runs, k * RUNS + 1, F.lit(RUNS))
        )
        mask = F.lit((1 << FIELD) - 1).cast("long")

        def field(packed: Column, k: int) -> Column:
            return F.aggregate(packed, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, FIELD * k).bitwiseAND(mask))

        def of_group(group: int, table: tuple[int, ...]) -> Column:
            # A literal, folded before anything runs.
            numbers = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
            languages = min(FIELDS, len(profiles.codes) - group * FIELDS)
            packed = bind(numbers, lambda t: F.transform(parts, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + F.get(t, b))))
            return bind(packed, lambda x: F.array(*[field(x, k) for k in range(languages)]))

        return F.concat(*[of_group(g, t) for g, t in enumerate(profiles.tables)])

    none = F.array(*[F.lit(0).cast("long") for _ in profiles.codes])
    return bind(runs_of(text), lambda r: F.when(F.size(r) > 0, summed(r)).otherwise(none))


def languages_of(text: Column, profiles: Profiles, share: float = SHARE) -> Column:
    """The languages of a text as (code, probability), the most probable first.

    The best one is always there, others from a probability of ``share`` on; equal ones in
    the order of their codes.  A text without any known run has none.
    """
    if not profiles.codes:
        return F.array().cast("array<struct<code:string,probability:double>>")

    def ranked(scores: Column) -> Column:
        best = F.array_max(scores)
        weights = F.transform(scores, lambda s: F.pow(F.lit(2.0), (s - best).cast("double")))
        whole = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
        codes = F.array(*[F.lit(c) for c in profiles.codes])
        each = F.transform(weights, lambda w, k: F.struct((-w / whole).alias("p"), F.get(codes, k).alias("code")))
        shown = F.filter(F.array_sort(each), lambda x, k: (k == 0) | (x["p"] <= -share))
        return F.when(best > 0, F.transform(shown, lambda x: F.struct(x["code"].alias("code"), (-x["p"]).alias("probability"))))

    empty = F.array().cast("array<struct<code:string,probability:double>>")
    return bind(scores_of(text, profiles), lambda s: F.coalesce(ranked(s), empty))


def codes_of(languages: Column) -> Column:
    return F.transform(languages, lambda x: x["code"])


def first_code(languages: Column) -> Column:
    return F.coalesce(F.get(codes_of(languages), F.lit(0)), F.lit(UNKNOWN))


def known_codes(codes: Sequence[str]) -> list[str]:
    """Codes of three letters for codes of two, where they are known."""
    return [CODES.get(c, c) for c in codes]
