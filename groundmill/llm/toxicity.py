"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; a category's logistic model sees the words of the text and
the probabilities of the categories before it.  For training these are out-of-fold predictions, so a
model never sees a probability fitted on its own row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmill.llm import _text as X

#: Labelled rows that training uses at most, about, with and without the last category.
TRAIN_POSITIVE, TRAIN_NEGATIVE = 4_000, 6_000
FOLDS, FEATURES, LEAST_DOCS, LEAST_Z, RIDGE = 5, 256, 3, 3.0, 1.0
#: Words are runs of ASCII letters and digits or of any non-ASCII characters.
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def distinct_words(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct word hashes of each text."""
    for lo, hi, data, off in X.pieces(column):
        low = X.LOWER[data]
        starts, ends, rows = X.words(low, off, BREAK)
        h = X.word_hashes(low, starts, ends)
        cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield X.unique(h[cuts[i] : cuts[i + 1]])


@dataclass
class Head:
    """A logistic model on the presence of some words and the probabilities before it."""

    words: np.ndarray
    weight: np.ndarray

    def predict(self, present: np.ndarray, before: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(present)), present, before]) @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Chain:
    categories: list[str]
    heads: list[Head] = field(default_factory=list)


def _presence(docs: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(docs), len(words)))
    if len(words):
        for i, d in enumerate(docs):
            at = np.minimum(np.searchsorted(words, d), len(words) - 1)
            out[i, at[words[at] == d]] = 1
    return out


def _fit_head(docs: list[np.ndarray], y: np.ndarray, before: np.ndarray) -> Head:
    """Choose the words that tell the classes apart most, then fit by Newton steps with a ridge."""
    every, inverse = np.unique(np.concatenate([*docs, np.zeros(0, np.uint64)]), return_inverse=True)
    label = np.repeat(y, [len(d) for d in docs])
    n = np.bincount(inverse, minlength=len(every)).astype(float)
    pos = np.bincount(inverse, label, minlength=len(every))
    odds = np.log((pos + 0.5) / (y.sum() - pos + 0.5)) - np.log((n - pos + 0.5) / (len(y) - y.sum() - n + pos + 0.5))
    z = odds / np.sqrt(1 / (pos + 0.5) + 1 / (n - pos + 0.5))
    z[n < LEAST_DOCS] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    words = np.sort(every[best[np.abs(z[best]) >= LEAST_Z]])  # weaker words are chance on small samples
    x = np.column_stack([np.ones(len(y)), _presence(docs, words), before])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge), g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Head(words, w)


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, categories: list[str], fold: np.ndarray) -> Chain:
    """Fit heads in order; each is trained with out-of-fold probabilities of those before it."""
    chain = Chain(categories)
    before = np.zeros((len(docs), 0))
    for j in range(len(categories)):
        y = labels[:, j].astype(float)
        out = np.full(len(docs), y.mean() if len(y) else 0.0)
        for f in range(FOLDS):
            rest, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(rest) and len(held):
                head = _fit_head([docs[i] for i in rest], y[rest], before[rest])
                out[held] = head.predict(_presence([docs[i] for i in held], head.words), before[held])
        chain.heads.append(_fit_head(docs, y, before))
        before = np.column_stack([before, out])
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", positive: int = TRAIN_POSITIVE, negative: int = TRAIN_NEGATIVE) -> Chain:
    """Fit on a bounded sample of the labelled rows: each class of the last category is thinned by hash.

    ``labels`` has ``id_col`` and a 0/1 column for each category.  Rows with a null label are left out, and an id counts
    once however often it occurs in ``labels`` (its largest labels) or in ``docs`` (one of its texts).
    """
    last = categories[-1]
    rows = labels.select(F.col(id_col).alias("_id"), *[F.col(c).cast("int").alias(f"_y_{c}") for c in categories]).dropna()
    rows = rows.groupBy("_id").agg(*[F.max(f"_y_{c}").alias(f"_y_{c}") for c in categories])
    n = {bool(r[0]): r[1] for r in rows.groupBy(F.col(f"_y_{last}") > 0).count().collect()}
    every = F.when(F.col(f"_y_{last}") > 0, F.lit(max(1, -(-n.get(True, 0) // positive)))).otherwise(F.lit(max(1, -(-n.get(False, 0) // negative))))
    rows = rows.where(F.pmod(F.xxhash64("_id"), every) == 0)  # about positive + negative different ids at most: small enough to broadcast
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = text.join(F.broadcast(rows), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), *[F.first(f"_y_{c}").alias(f"_y_{c}") for c in categories])
    found = found.select("_text", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(FOLDS)).alias("fold"), *[f"_y_{c}" for c in categories])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array([w.tobytes() for w in distinct_words(b.column(0))], pa.binary())
            yield pa.RecordBatch.from_arrays([words, *b.columns[1:]], ["words", *b.schema.names[1:]])

    got = found.mapInArrow(run, "words binary, fold long, " + ", ".join(f"`_y_{c}` int" for c in categories)).toPandas()
    got = got.sort_values(["words", "fold"], kind="stable")  # the fit must not follow the order of arrival
    y = got[[f"_y_{c}" for c in categories]].to_numpy()
    return fit_chain([np.frombuffer(x, np.uint64) for x in got["words"]], y, categories, got["fold"].to_numpy())


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_<category> for each, score, predicted): the last category's probability and decision.

    Null and empty texts have no words and get the models' base rates.  Rows are neither joined nor
    dropped: null and repeated ids pass; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = sent.value.heads
        every = np.unique(np.concatenate([h.words for h in heads])) if heads else np.zeros(0, np.uint64)
        picks = [np.searchsorted(every, h.words) for h in heads]
        for b in batches:
            have = _presence(list(distinct_words(b.column(1))), every)
            before = np.zeros((b.num_rows, 0))
            for h, pick in zip(heads, picks, strict=True):
                before = np.column_stack([before, h.predict(have[:, pick], before)])
            last = before[:, -1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(before[:, j]) for j in range(len(heads))], pa.array(last), pa.array((last >= threshold).astype(np.int32))],
                ["doc_id", *names, "score", "predicted"],
            )

    schema = "doc_id long, " + ", ".join(f"`{n}` double" for n in names) + ", score double, predicted int"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
