"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lowered, all else is a blank; runs of 1 to 3 characters hash into ORDERS x BUCKETS columns.
The matrix of log-probabilities (languages x columns, a few MB) is broadcast, and a batch is scored as a
sparse product in numpy: the columns of its n-grams, row after row, gather and sum the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from groundmill.llm import _text as X

ORDERS, BUCKETS = 3, 1 << 15
#: Documents of each language that training reads at most, about: every M-th by hash, M from the count.
TRAIN_PER_LANGUAGE = 4_000
SMOOTHING = 0.5
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> np.ndarray:
    """Per code point: the lowered letter, or 32 for anything that is no letter."""
    if "fold" not in _TABLES:
        fold = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _TABLES["fold"] = fold
    return _TABLES["fold"]


def ngrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, columns [ORDERS, n], which of them count, row starts): all texts are blank-padded."""
    fold = _tables()
    for lo, hi, data, off in X.pieces(column, X.PIECE // 2):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        at = lead[off]
        c = fold[points]
        c = np.insert(c, np.repeat(at[1:], 2), 32)
        starts = at[:-1] + 2 * np.arange(hi - lo)
        c1, c2 = np.append(c[1:], 32), np.append(c[2:], [32, 32])[: len(c)]
        c = c.astype(np.uint32)
        c1, c2 = c1.astype(np.uint32), c2.astype(np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = (one ^ (c1 * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two ^ (c2 * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        cols = np.stack([one, two, three]) >> np.uint32(17)
        cols += (np.arange(ORDERS, dtype=np.uint32) * np.uint32(BUCKETS))[:, None]
        some = c != 32
        yield lo, hi, cols, some, starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs = np.array(b.column(1).to_pylist(), object)
        for lo, _hi, cols, some, starts in ngrams(b.column(0)):
            row = np.searchsorted(starts, np.arange(len(some)), "right") - 1
            for lang in set(langs[lo:_hi]):
                mine = some & (langs[lo:_hi] == lang)[row]
                got = np.bincount(cols[:, mine].ravel(), minlength=ORDERS * BUCKETS)
                total[lang] = total.get(lang, 0) + got
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "col", "n"])


@dataclass
class LanguageModel:
    """Languages in order, log-priors, and log-probabilities [columns, languages]."""

    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> LanguageModel:
    """Fit on rows with a language; priors and sampling rates come from the counts of all of them."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = known.groupBy("lang").count().collect()  # a row for each language
    if not rows:
        return LanguageModel([], np.zeros(0), np.zeros((ORDERS * BUCKETS, 0), np.float32))
    counts = {r["lang"]: r["count"] for r in rows}
    langs = sorted(counts)
    keep = F.lit(False)
    for lang in langs:
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("text"), F.lit(max(1, -(-counts[lang] // per_language)))) == 0))
    got = known.where(keep).mapInArrow(_count, "lang string, col int, n long").groupBy("lang", "col").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((ORDERS * BUCKETS, len(langs)))
    where = {x: i for i, x in enumerate(langs)}
    if len(got):
        table[got["col"].to_numpy(), got["lang"].map(where).to_numpy()] = got["n"].to_numpy()
    logp = np.empty_like(table)
    for k in range(ORDERS):
        part = slice(k * BUCKETS, (k + 1) * BUCKETS)
        x = table[part] + SMOOTHING
        logp[part] = np.log(x / x.sum(0))
    n = np.array([counts[x] for x in langs], float)
    return LanguageModel(langs, np.log(n / n.sum()), logp.astype(np.float32))


def score(column: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text."""
    names, values = [], []
    for lo, hi, cols, some, starts in ngrams(column):
        letters = np.add.reduceat(some.astype(np.int64), starts)
        total = np.tile(model.prior, (hi - lo, 1))
        if model.langs:
            for k in range(ORDERS):
                got = model.logp[cols[k]]
                got[~some] = 0
                total += np.add.reduceat(got, starts, axis=0, dtype=np.float64)
            best = total.argmax(1)
            p = np.exp(total - total.max(1, keepdims=True))
            p = p[np.arange(hi - lo), best] / p.sum(1)
        for i in range(hi - lo):
            known = letters[i] > 0 and bool(model.langs)
            names.append(model.langs[best[i]] if known else "und")
            values.append(float(p[i]) if known else 0.0)
    return names, np.array(values, float)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) for each row, the columns in ``keep``, and ``text`` if asked for.

    A text that is null, empty or has no letter, or a model without languages, gives ``und`` and 0.
    Equal scores go to the language that comes first by name.  Rows are neither joined nor dropped, so
    null and repeated ids pass; columns not in ``keep`` are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *keep)
    rest = chosen if with_text else chosen.drop("text")
    skip = 0 if with_text else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, values = score(b.column(0), sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns[skip:], pa.array(names, pa.string()), pa.array(values)], [*b.schema.names[skip:], "lang_pred", "score"])

    return chosen.mapInArrow(run, StructType([*rest.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
