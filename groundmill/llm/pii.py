"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Everything is Spark SQL.  Offsets come from ``split`` (the gaps) and ``regexp_extract_all`` (the matches), which tile the
text; they are summed within chunks, then over chunks, so a text with very many spans stays linear.  Lengths are code
points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmill.functions.text import in_chunks, tiles

SPAN = "array<struct<start:int,end:int,value:string>>"

#: Possessive forms of the contract's patterns.  A run's later starts can't match where its first one
#: fails, so they are skipped, but for a start right after the previous match (``\\G``): long runs stay linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this can't have the kind.
NEEDS = {"email": "@", "phone": "+"}
#: Prior score of a confirmed span, and the words that add CONTEXT_GAIN within REACH code points of it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": "e-?mail|contact|write|reach", "ip": "ip|address|host|server", "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank", "ssn": "ssn|social|security",
}
CONTEXT_GAIN, REACH, LEAST = 0.2, 40, 0.5


def _none() -> Column:
    return F.array().cast(SPAN)


def find(text: Column, pattern: str) -> Column:
    """All matches with code-point offsets, leftmost and non-overlapping."""
    return F.coalesce(tiles(text, pattern), _none())


def _mod97(value: Column) -> Column:
    """The remainder of an account number with its first four signs moved to its end, letters as 10 to 35."""
    bare = F.regexp_replace(value, " ", "")
    signs = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "(?<=.)(?=.)")
    return F.aggregate(
        signs, F.lit(0),
        lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )


def valid(kind: str, value: Column) -> Column:
    """Whether the checksum or range rule of ``kind`` holds."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return _mod97(value) == 1
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9..)-|-00-|-0000$")
    return F.lit(True)


def _valid(kind: str):
    return lambda x: valid(kind, x["value"])


def _of(kind: str):
    return lambda x: x["kind"] == kind


def _scored(kind: str, spans: Column, text: Column) -> Column:
    """The spans with their kind and score."""

    def one(x: Column) -> Column:
        lo = F.greatest(x["start"] - REACH, F.lit(0))
        near = F.lower(F.concat(F.substr(text, lo + 1, x["start"] - lo), F.lit(" "), F.substr(text, x["end"] + 1, F.lit(REACH))))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])"), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.round(score, 3).alias("score"))

    return F.transform(spans, one)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``pii``: array<struct<kind,start,end,score>>, by kind as listed, then start.

    Base kinds (email, ip, card, phone) hold every confirmed match; ``iban`` and ``ssn`` are added from a
    score of LEAST.  Offsets are code points of the text, end exclusive.  Null and empty texts give an
    empty array; rows are neither joined nor dropped, so repeated rows, null ids and other columns pass.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digits = text.rlike("[0-9]")
    cols = {}
    for kind, pattern in (PATTERNS | EXTRA).items():
        may = F.instr(text, NEEDS[kind]) > 0 if kind in NEEDS else digits
        hits = F.filter(find(text, pattern), _valid(kind))
        cols[f"_pii_{kind}"] = F.when(may, hits).otherwise(_none())
    found = docs.withColumns(cols)
    all_ = F.concat(*[_scored(k, F.col(f"_pii_{k}"), text) for k in PATTERNS], *[F.filter(_scored(k, F.col(f"_pii_{k}"), text), lambda x: x["score"] >= LEAST) for k in EXTRA])
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    none = F.greatest(*[F.size(c) for c in cols]) == 0
    return found.withColumn("pii", F.when(none, empty).otherwise(all_)).drop(*cols)


def digest(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, their digest, and all spans as text."""
    found = find_pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = F.filter("pii", lambda x: x["kind"].isin(*PATTERNS))
    count = [F.size(F.filter("pii", _of(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select(
        "doc_id", *count, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"),
        F.array_max(F.transform("pii", lambda x: x["score"])).alias("max_score"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets.

    Overlapping spans are replaced once, by the kind that starts first (the longer one at ties).  Texts
    without a span are returned as they are, null included.
    """
    found = find_pii(docs, text_col)
    text = F.col(text_col)
    order = F.array_sort(F.transform("pii", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus"), x["kind"].alias("kind"))))

    def furthest(part: Column) -> Column:
        return F.array_max(F.transform(part, lambda x: -x["minus"]))

    def pieces(part: Column, before: Column) -> Column:
        """The text between spans and the kinds, of one chunk: spans that begin before the furthest end are covered."""

        def step(acc: Column, x: Column) -> Column:
            new = F.array(F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
            out = F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], new))
            return F.struct(F.greatest(acc["at"], -x["minus"]).alias("at"), out.alias("out"))

        return F.aggregate(part, F.struct(before.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.array_join(acc["out"], ""))

    def walk_chunks(parts: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(F.greatest(acc["at"], furthest(x)).alias("at"), F.concat(acc["out"], F.array(pieces(x, acc["at"]))).alias("out"))

        last = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, last)

    walk = walk_chunks(F.get(in_chunks(order, lambda part: part), F.lit(0)))
    return found.withColumn(text_col, F.when(F.size("pii") > 0, walk).otherwise(text)).drop("pii")
