"""Column expressions over text: lookup keys, windows, similarities and code forms.

Offsets are half-open code-point offsets into the raw text.  Normalised text is only a lookup key.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _unmarked(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        x = "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")
        return x.replace("đ", "d").replace("Đ", "D")

    return s.map(one)


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_for_match(text: Column, nfkc: bool = True) -> Column:
    """The lookup key: NFKC, lower case, only word characters and ``/+.-``, single blanks.

    NFKC has no built-in; with ``nfkc=False`` (texts known to be in that form) the key stays in the JVM.
    """
    return squeeze(F.regexp_replace(F.lower(_nfkc(text) if nfkc else text), r"(?U)[^\w\s/+.-]", " "))


#: Accented letters of the common Latin alphabets with their plain letters (fixed values).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿđăơưÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝĐĂƠƯ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyydaouAAAAAACEEEEIIIINOOOOOUUUUYDAOU"


def toneless(text: Column, latin: bool = False) -> Column:
    """The text without diacritics, ``đ`` as ``d``; ``latin`` uses a JVM table for the common letters only."""
    return F.translate(text, ACCENTED, PLAIN) if latin else _unmarked(text)


def tokens(text: Column, pattern: str = r"[^\p{L}\p{N}]+") -> Column:
    """Lower-cased runs of letters and numbers, in order."""
    return F.filter(F.split(F.lower(text), pattern), lambda t: t != "")


def token_set(text: Column) -> Column:
    """The distinct white-space tokens of a key."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def span_slice(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]``."""
    return F.substr(text, start + 1, end - start)


SPANS = "array<struct<start:int,end:int,value:string>>"
#: Elements that one running fold appends to: an append copies what is there, so longer lists are folded in two levels.
FOLD = 128


def in_chunks(items: Column, f, size: int = FOLD) -> Column:
    """``f`` of each run of ``size`` items (bound once), as an array."""
    def whole(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / size).cast("int") - 1), lambda i: f(F.slice(x, i * size + 1, F.lit(size))))

    return F.transform(F.filter(F.array(items), lambda x: F.size(x) > 0), whole)


def tiles(text: Column, pattern: str | Column) -> Column:
    """All matches of ``pattern`` as array<struct<start,end,value>>, leftmost and non-overlapping.

    Gaps and matches tile the text, so offsets are sums of lengths.  They run within chunks, then over the chunks, so a
    text with very many matches costs little more than its length.
    """
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        new = F.array(F.struct(s.alias("start"), (s + F.length(x["hit"])).alias("end"), x["hit"].alias("value")))
        return F.struct(F.coalesce(s + F.length(x["hit"]), s).alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], new)).alias("out"))

    def chunk(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")), step)

    def shift(acc: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end"), m["value"].alias("value")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    folded = F.get(in_chunks(both, chunk), F.lit(0))
    joined = F.aggregate(folded, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")), shift, lambda acc: F.flatten(acc["out"]))
    return F.coalesce(joined, F.when(text.isNotNull(), F.array().cast(SPANS)))


def text_window(text: Column, start: Column, end: Column, radius: int) -> Column:
    """The text around a span, ``radius`` code points either way, clamped."""
    lo = F.greatest(start - radius, F.lit(0))
    return F.substr(text, lo + 1, F.least(end + radius, F.length(text)) - lo)


def valid_span(text: Column, start: Column, end: Column, mention: Column) -> Column:
    """Whether the span lies in the text and reads as the mention."""
    return (start >= 0) & (start < end) & (end <= F.length(text)) & (span_slice(text, start, end) == mention)


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap of two intervals over their hull."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)) / (F.greatest(e1, e2) - F.least(s1, s2))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_dice(a: Column, b: Column) -> Column:
    """Dice of two arrays as sets; two empty ones are equal."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def token_edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance between two arrays of tokens, each token read as one sign of a common alphabet."""
    every = F.array_union(left, right)
    code = lambda arr: F.array_join(F.transform(arr, lambda t: F.char(F.array_position(every, t) + 64)), "")
    return F.levenshtein(code(left), code(right))


def text_similarity(gold: Column, other: Column) -> Column:
    """One less the token edits over the gold's tokens, at least 0."""
    return F.greatest(F.lit(0.0), 1 - token_edit_distance(gold, other) / F.greatest(F.size(gold), F.lit(1)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity without the popular-element rule."""
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def lexical_similarity(a: Column, b: Column) -> Column:
    """The larger of sequence ratio and token Dice; at most 0.49 if both have numbers and share none."""
    best = F.greatest(sequence_ratio(a, b), set_dice(token_set(a), token_set(b)))
    na, nb = F.regexp_extract_all(a, F.lit(r"(\d+)")), F.regexp_extract_all(b, F.lit(r"(\d+)"))
    clash = (F.size(na) > 0) & (F.size(nb) > 0) & ~F.arrays_overlap(na, nb)
    return F.when(clash, F.least(best, F.lit(0.49))).otherwise(best)


def char_ngrams(text: Column, sizes: tuple[int, ...] = (3,)) -> Column:
    """All runs of the given numbers of characters, in order, repeats kept."""
    one = [_grams(text, n) for n in sizes]
    return F.concat(*one)


def _grams(text: Column, n: int) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, made).otherwise(F.array().cast("array<string>"))


def ndc11(value: Column) -> Column:
    """An NDC of 4-4-2, 5-3-2 or 5-4-1 digits as 11 digits, 5-4-2; null for any other form."""
    p = F.split(value, "-")
    pad = F.concat(F.lpad(F.get(p, 0), 5, "0"), F.lpad(F.get(p, 1), 4, "0"), F.lpad(F.get(p, 2), 2, "0"))
    return F.when(value.rlike(r"^(?:\d{4}-\d{4}-\d{2}|\d{5}-\d{3}-\d{2}|\d{5}-\d{4}-\d{1})$"), pad).when(value.rlike(r"^\d{5}-\d{4}-\d{2}$"), F.replace(value, F.lit("-"), F.lit(""))).when(value.rlike(r"^\d{11}$"), value)


def ndc_product(value: Column) -> Column:
    """The nine digits of labeler and product of an NDC of two or three segments."""
    p = F.split(value, "-")
    return F.when(value.rlike(r"^\d{4,5}-\d{3,4}(?:-\d{1,2})?$"), F.concat(F.lpad(F.get(p, 0), 5, "0"), F.lpad(F.get(p, 1), 4, "0")))


#: First and last three-character category of each ICD-10 chapter (fixed values).
ICD10_CHAPTERS = [
    ("I", "A00", "B99"), ("II", "C00", "D49"), ("III", "D50", "D89"), ("IV", "E00", "E90"), ("V", "F00", "F99"), ("VI", "G00", "G99"),
    ("VII", "H00", "H59"), ("VIII", "H60", "H95"), ("IX", "I00", "I99"), ("X", "J00", "J99"), ("XI", "K00", "K93"), ("XII", "L00", "L99"),
    ("XIII", "M00", "M99"), ("XIV", "N00", "N99"), ("XV", "O00", "O99"), ("XVI", "P00", "P96"), ("XVII", "Q00", "Q99"), ("XVIII", "R00", "R99"),
    ("XIX", "S00", "T98"), ("XX", "V01", "Y98"), ("XXI", "Z00", "Z99"), ("XXII", "U00", "U99"),
]


def icd10_chapter(code: Column) -> Column:
    """The chapter of a code by the range of its category; null outside all."""
    cat = F.upper(F.substring(code, 1, 3))
    return F.when(cat.rlike("^[A-Z][0-9][0-9A-Z]$"), F.coalesce(*[F.when(cat.between(a, b), F.lit(name)) for name, a, b in ICD10_CHAPTERS]))
