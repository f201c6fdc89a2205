"""Text quality by a generalised additive model with pairwise interactions.

Features of a text are binned; cyclic boosting fits a shallow tree to one feature at a time, in turn,
and adds it to that feature's lookup table; the pairs that explain most of the residual get tables of
their own in the same way.  A score is the sum of the bins' entries through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmill.llm import _text as X

#: Labelled rows that training uses at most, about (thinned by hash), bins of a feature and of a pair's side.
TRAIN_ROWS, BINS, PAIR_BINS, PAIRS = 20_000, 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST_LEAF, SHRINK = 120, 40, 0.1, 3, 5, 1.0
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "non_ascii", "symbol_words", "symbol_ends",
    "short_words", "capital_words", "type_share", "top_word", "line_length", "repeated_lines", "stop_ends",
)
_LETTER, _UPPER, _DIGIT = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_LETTER[[*range(65, 91), *range(97, 123)]] = 1
_DIGIT[48:58] = 1
_HIGH = np.zeros(256)
_HIGH[128:] = 1
_SYMBOL = 1 - _LETTER - _DIGIT - _HIGH - X.SPACE
#: Signs that end sentences or clauses are no noise by themselves.
_PLAIN = np.zeros(256)
_PLAIN[[ord(c) for c in ".,;:?'\"()-"]] = 1
_NOISE = np.clip(_SYMBOL - _PLAIN, 0, 1)
_LINE = np.zeros(256, bool)
_LINE[10] = True


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; all but the two sizes are shares or means."""
    out = np.zeros((len(column), len(FEATURES)))
    for lo, hi, data, off in X.pieces(column):
        n = hi - lo
        size = np.diff(off).astype(float)

        def share(table: np.ndarray, data=data, off=off, size=size) -> np.ndarray:
            total = np.concatenate([[0.0], np.cumsum(table[data])])
            return (total[off[1:]] - total[off[:-1]]) / np.maximum(size, 1)

        starts, ends, rows = X.words(data, off)
        count = np.bincount(rows, minlength=n).astype(float)
        per = np.maximum(count, 1)
        mean = lambda x, rows=rows, n=n, per=per: np.bincount(rows, x, minlength=n) / per
        length = (ends - starts).astype(float)
        first, last = data[starts], data[ends - 1]
        noise = np.concatenate([[0.0], np.cumsum(_NOISE[data])])
        h = X.word_hashes(X.LOWER[data], starts, ends)
        distinct, top = _repeats(h, rows, n)
        ls, le, lr = X.words(data, off, _LINE)
        lines = np.bincount(lr, minlength=n).astype(float)
        different, _ = _repeats(X.word_hashes(data, ls, le), lr, n)
        f = [
            np.log1p(size), np.log1p(count), mean(length), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_HIGH),
            mean((noise[ends] - noise[starts] == length).astype(float)), mean(_NOISE[last]), mean((length <= 3).astype(float)),
            mean(_UPPER[first]), distinct / np.maximum(per, 1) * np.log1p(count), top / per,
            np.log1p(size / np.maximum(lines, 1)), 1 - different / np.maximum(lines, 1), np.bincount(rows, _PLAIN[last], minlength=n) / per,
        ]
        out[lo:hi] = np.stack(f, 1)
    return out


def _repeats(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes a row has, and how often its most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, rows[first], runs)
    return np.bincount(rows[first], minlength=n).astype(float), top


@dataclass
class AdditiveModel:
    """Bin edges per feature and per pair side, lookup tables, and the intercept."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edge, x[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """A tree of few leaves over ordered bins, as the value of each bin: Newton steps on gradient sums."""
    cuts = [(0, len(g))]
    G, H, N = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + SHRINK)
    while len(cuts) < leaves:
        best = (1e-9, None, None)
        for a, b in cuts:
            c = np.arange(a + 1, b)
            c = c[(N[c] - N[a] >= LEAST_LEAF) & (N[b] - N[c] >= LEAST_LEAF)]
            if len(c):
                v = gain(a, c) + gain(c, b) - gain(a, b)
                k = int(v.argmax())
                if v[k] > best[0]:
                    best = (v[k], (a, b), int(c[k]))
        if best[1] is None:
            break
        a, b = best[1]
        cuts.remove((a, b))
        cuts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in cuts:
        out[a:b] = -(G[b] - G[a]) / (H[b] - H[a] + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """The best split of one side, then one of the other within each half: up to four leaves, and their gain."""
    best, gain = np.zeros_like(g), 0.0
    for turn in (False, True):
        G, H, N = (v.T if turn else v for v in (g, h, n))
        for c in range(1, len(G)):
            table, total = np.zeros_like(G), 0.0
            for part in (slice(0, c), slice(c, len(G))):
                row = _tree(G[part].sum(0), H[part].sum(0), N[part].sum(0), 2)
                table[part] = row
                total -= float((row * G[part].sum(0)).sum())
            if total > gain:
                best, gain = (table.T if turn else table), total
    return best, gain


def fit_rows(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit on features and 0/1 labels; without rows the score is a half, with one class its smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    d = len(FEATURES)
    if not len(y):
        return AdditiveModel(base, [np.zeros(0)] * d, [np.zeros(1)] * d, [np.zeros(0)] * d, [], [])
    edges = [_edges(x[:, j], BINS) for j in range(d)]
    bins = [np.searchsorted(edges[j], x[:, j], "right") for j in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    number = [np.bincount(b, minlength=len(t)).astype(float) for b, t in zip(bins, tables, strict=True)]
    z = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j in range(d):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(bins[j], p - y, len(tables[j])), np.bincount(bins[j], p * (1 - p), len(tables[j])), number[j], LEAVES)
            tables[j] += step
            z += step[bins[j]]
    pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(d)]
    wide = [len(e) + 1 for e in pair_edges]
    pbins = [np.searchsorted(pair_edges[j], x[:, j], "right") for j in range(d)]

    def sums(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, ...]:
        at = pbins[i] * wide[j] + pbins[j]
        return tuple(np.bincount(at, v, wide[i] * wide[j]).reshape(wide[i], wide[j]) for v in (p - y, p * (1 - p), np.ones(len(y))))

    p = 1 / (1 + np.exp(-z))
    ranked = sorted(((_pair_tree(*sums(i, j, p))[1], i, j) for i in range(d) for j in range(i)), key=lambda v: (-v[0], v[1], v[2]))
    pairs = [(i, j) for g, i, j in ranked[:PAIRS] if g > 0]
    pair_tables = [np.zeros((wide[i], wide[j])) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(pairs, pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _pair_tree(*sums(i, j, p))[0]
            table += step
            z += step[pbins[i], pbins[j]]
    return AdditiveModel(base, edges, tables, pair_edges, pairs, pair_tables)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on labelled texts; only features of a bounded sample, thinned by a hash of the id, reach the driver.

    An id counts once however often it occurs in ``labels`` (its largest label) or in ``docs`` (one of its texts).
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    every = max(1, -(-known.count() // rows))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(every)) == 0)  # about ``rows`` different ids at most: small enough to broadcast
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, j]) for j in range(x.shape[1])], b.column(1)], [*FEATURES, "_y"])

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", _y int"
    sample = text.join(F.broadcast(known), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"))
    got = sample.select("_text", "_y").mapInArrow(run, schema).toPandas()
    got = got.sort_values([*FEATURES, "_y"], kind="stable")
    return fit_rows(got[list(FEATURES)].to_numpy(), (got["_y"].to_numpy() > 0).astype(float))


def score_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted): the probability of good quality, and whether it is a half or more.

    Null and empty texts are scored like any other, with features of zero.  Rows are neither joined nor
    dropped: null and repeated ids pass; other columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = sent.value.score(features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
