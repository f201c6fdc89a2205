"""Benchmark decontamination: every training passage queries a BM25 index of test items.

The index holds the test items: per term its postings in blocks of BLOCK_ITEMS items, with the greatest
weight of each block.  Weights are divided by the item's score for itself, so a score is the share of
the item found, and one threshold serves all items.  A passage's block bounds (the sum of its terms'
block maxima) are computed for all passages of a batch at once.  This is block-max WAND (Ding and Suel 2011)
with many queries abreast: lists' maxima rule out passages, blocks' maxima rule out blocks of a passage,
and only blocks whose bound reaches the threshold have their postings read and scored, so every item at
or above it is retrieved.  ``wand`` is the same search for one query, by pivots.  Items retrieved are verified on the text: the share of the question's and of the answer's word
runs that the passage holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmill.llm import _text as X
from groundmill.llm._store import cut

K1, B = 1.2, 0.3
#: Words of a passage (twice the stride), and the share of an item's own score that retrieves it.
PASSAGE, THRESHOLD = 128, 0.55
#: Shares of the question's and the answer's word runs of RUN words that a verified passage holds.
RUN, QUESTION, ANSWER = 3, 0.7, 0.7
BLOCK_ITEMS = 8
#: Test items of one index: more are searched in several passes over the passages, each with its own broadcast index
#: but with terms and lengths counted over all items.
INDEX_ITEMS = 1_024
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, data, off in X.pieces(column):
        low = X.LOWER[data]
        starts, ends, rows = X.words(low, off, BREAK)
        yield lo, hi, X.word_hashes(low, starts, ends), rows, starts


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: its last line or sentence is the answer, if there is more than one."""
    text = text.strip()
    body = text.rstrip(".!?")
    at = max(body.rfind("\n"), *(body.rfind(s) + 1 if body.rfind(s) >= 0 else -1 for s in (". ", "? ", "! ")))
    return (text[:at].strip(), text[at:].strip()) if at > 0 else (text, "")


def _runs(h: np.ndarray) -> np.ndarray:
    k = min(RUN, len(h))
    return np.unique(X.shingles(h, np.zeros(len(h), np.int64), 1, k)[0]) if k else np.zeros(0, np.uint64)


@dataclass
class Index:
    """Postings by term, sorted by item: ``begin`` per term; blocks of items with their greatest weights."""

    items: list[int]
    terms: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    block_max: np.ndarray
    greatest: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]


def _read(text: str | None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]] | None:
    """Word hashes of an item, its question and its answer; None without words."""
    h = [x for _, _, x, _, _ in _words(pa.array([text or ""]))]
    if not h or not len(h[0]):
        return None
    return h[0], tuple(next((x for _, _, x, _, _ in _words(pa.array([p]))), np.zeros(0, np.uint64)) for p in split_item(text or ""))


@dataclass
class Whole:
    """Of all items: how many have words, their mean length, and in how many each term occurs (``terms`` ascending)."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def build(items: list[tuple[int, str]], whole: Whole | None = None) -> Index:
    """The index of (item id, text) pairs, all or a part of ``whole``; items without words are left out."""
    kept, docs, parts = [], [], []
    for i, text in items:
        if read := _read(text):
            kept.append(i)
            docs.append(read[0])
            parts.append(read[1])
    n = len(docs)
    terms = np.unique(np.concatenate([*docs, np.zeros(0, np.uint64)]))
    t, d, w = [], [], []
    df = np.zeros(len(terms))
    counted = []
    for x in docs:
        u, c = np.unique(np.searchsorted(terms, x), return_counts=True)
        counted.append((u, c))
        df[u] += 1
    if whole is None:
        whole = Whole(n, np.mean([len(x) for x in docs]) if n else 1.0, terms, df)
    df = whole.df[np.searchsorted(whole.terms, terms)]
    idf = np.log(1 + (whole.n - df + 0.5) / (df + 0.5))
    for j, (u, c) in enumerate(counted):
        v = idf[u] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(docs[j]) / whole.mean))
        t.append(u)
        d.append(np.full(len(u), j))
        w.append(v / v.sum())
    t, d, w = (np.concatenate([*x, np.zeros(0)]) for x in (t, d, w))
    order = np.lexsort((d, t))
    t, d, w = t[order].astype(np.int64), d[order].astype(np.int64), w[order]
    begin = np.searchsorted(t, np.arange(len(terms) + 1))
    block_max = np.zeros((len(terms), -(-n // BLOCK_ITEMS)), np.float32)
    np.maximum.at(block_max, (t, d // BLOCK_ITEMS), np.nextafter(w.astype(np.float32), np.float32(2)))
    blocks = block_max.shape[1]
    at = np.searchsorted(t * blocks + d // BLOCK_ITEMS, np.arange(len(terms) * blocks + 1))  # postings of each term and block
    greatest = block_max.max(1) if n else np.zeros(0, np.float32)
    return Index(kept, terms, begin, d, w, at, block_max, greatest, [_runs(p[0]) for p in parts], [_runs(p[1]) for p in parts])


def wand(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """Block-max WAND: all items whose score for the distinct ``terms`` reaches the threshold, with the score."""
    lists = [(index.item[index.begin[t] : index.begin[t + 1]], index.weight[index.begin[t] : index.begin[t + 1]], float(index.greatest[t]), int(t)) for t in terms]
    at = [0] * len(lists)
    n, out = len(index.items), []
    slack = threshold - 1e-6
    while True:
        live = sorted((int(lists[i][0][at[i]]), i) for i in range(len(lists)) if at[i] < len(lists[i][0]))
        total, pivot = 0.0, -1
        for p, (_, i) in enumerate(live):
            total += lists[i][2]
            if total >= slack:
                pivot = p
                break
        if pivot < 0:
            return out
        doc = live[pivot][0]
        while pivot + 1 < len(live) and live[pivot + 1][0] == doc:
            pivot += 1
        block = doc // BLOCK_ITEMS
        if sum(float(index.block_max[lists[i][3], block]) for _, i in live[: pivot + 1]) < slack:
            after = min((block + 1) * BLOCK_ITEMS, live[pivot + 1][0] if pivot + 1 < len(live) else n)
            for _, i in live[: pivot + 1]:
                at[i] += int(np.searchsorted(lists[i][0][at[i] :], max(after, doc + 1)))
            continue
        if live[0][0] == doc:
            score = sum(float(lists[i][1][at[i]]) for d, i in live if d == doc)
            if score >= slack:
                out.append((doc, score))
            for d, i in live:
                if d == doc:
                    at[i] += 1
        else:
            for d, i in live[: pivot + 1]:
                if d < doc:
                    at[i] += int(np.searchsorted(lists[i][0][at[i] :], doc))


def passages(index: Index, h: np.ndarray, rows: np.ndarray, n: int, passage: int, threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """(row, first word, item, score) for all items that a passage of these texts retrieves.

    Passages have ``passage`` words and start at every half of one: an item of up to half a passage lies
    within one whole; a text's tail belongs to its last passage.
    """
    if not len(h) or not index.items:
        return
    half = passage // 2
    spot = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    hit = index.terms[spot] == h
    first = np.searchsorted(rows, np.arange(n))
    within = np.arange(len(h)) - first[rows]
    count = np.bincount(rows, minlength=n)
    chunks = np.maximum(1, -(-count // half))
    base = np.concatenate([[0], np.cumsum(chunks)])
    chunk = base[rows] + within // half
    pair = X.unique(chunk[hit] * np.int64(len(index.terms)) + spot[hit])
    c, t = pair // len(index.terms), pair % len(index.terms)
    cuts = np.searchsorted(c, np.arange(base[-1] + 1))
    # first the greatest weights alone, then the block maxima of the chunks that are left
    most = np.concatenate([[0.0], np.cumsum(index.greatest[t], dtype=np.float64)])
    bound = most[cuts[1:]] - most[cuts[:-1]]
    last = np.zeros(base[-1], bool)
    last[base[1:] - 1] = True
    beside = np.append(bound[1:], 0.0)
    beside[last] = 0.0
    slack = threshold - 1e-4
    maybe = np.flatnonzero(bound + beside >= slack)
    maybe = maybe[~(last[maybe] & np.append([False], ~last[:-1])[maybe])] if len(maybe) else maybe  # a tail is in the passage before it
    for p in range(0, len(maybe), 4096):
        some = maybe[p : p + 4096]
        use = X.unique(np.concatenate([some, some[~last[some]] + 1]))
        where = np.concatenate([np.arange(cuts[x], cuts[x + 1]) for x in use])
        lens = cuts[use + 1] - cuts[use]
        total = np.zeros((len(use), index.block_max.shape[1]), np.float32)
        full = np.flatnonzero(lens > 0)
        if len(full):
            total[full] = np.add.reduceat(index.block_max[t[where]], np.concatenate([[0], np.cumsum(lens[full])[:-1]]), axis=0)
        one = total[np.searchsorted(use, some)]
        two = np.where(last[some][:, None], 0, total[np.minimum(np.searchsorted(use, some + 1), len(use) - 1)])
        q, block = np.nonzero(one + two >= slack)
        if len(q):
            yield from _score(index, some, q, block, c, t, cuts, last, base, half, threshold)


def _score(index: Index, some, q, block, c, t, cuts, last, base, half: int, threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """Score the items of each passage's surviving blocks from their postings."""
    x = some[q]
    end = cuts[np.where(last[x], x + 1, np.minimum(x + 2, len(cuts) - 1))]
    lens = end - cuts[x]
    total = np.concatenate([[0], np.cumsum(lens)])
    pair = np.repeat(np.arange(len(x)), lens)
    term = t[np.repeat(cuts[x] - total[:-1], lens) + np.arange(int(total[-1]))]
    both = X.unique(pair * np.int64(len(index.terms)) + term)
    pair, term = both // len(index.terms), both % len(index.terms)
    where = term * index.block_max.shape[1] + block[pair]
    lens = index.at[where + 1] - index.at[where]
    total = np.concatenate([[0], np.cumsum(lens)])
    post = np.repeat(index.at[where] - total[:-1], lens) + np.arange(int(total[-1]))
    score = np.bincount(np.repeat(pair, lens) * BLOCK_ITEMS + index.item[post] % BLOCK_ITEMS, index.weight[post], len(x) * BLOCK_ITEMS)
    for k in np.flatnonzero(score >= threshold - 1e-6):
        p = int(x[k // BLOCK_ITEMS])
        row = int(np.searchsorted(base, p, "right")) - 1
        yield row, (p - int(base[row])) * half, int(block[k // BLOCK_ITEMS]) * BLOCK_ITEMS + int(k) % BLOCK_ITEMS, float(score[k])


def _wide(question: np.ndarray, answer: np.ndarray) -> int:
    return len(question) + len(answer) + 2 * RUN


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item with words: its slice, words, width and distinct terms."""
    for b in batches:
        rows = []
        for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if read := _read(t):
                rows.append((p, len(read[0]), _wide(*map(_runs, read[1])), np.unique(read[0]).view(np.int64)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["slice", "words", "wide", "terms"])


def _share(part: np.ndarray, held: np.ndarray) -> float:
    return float(np.isin(part, held).mean()) if len(part) else 1.0


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", passage: int = PASSAGE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and retrieved item: (doc_id, item_id, word, score, question, answer, leak).

    ``word`` is where the best passage starts, ``question`` and ``answer`` the shares of the item's word runs
    in the text around it, ``leak`` whether both reach their bound (an item of one sentence has no answer:
    1).  Null and empty texts retrieve nothing, items without words are never retrieved; repeated rows
    give repeated results; an item's length widens the passages where it needs to.  An empty table on
    either side gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    out = None
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = items.count()
    passes = max(1, -(-n // INDEX_ITEMS))
    if passes > 1:
        counts = cut(items.withColumn("slice", F.pmod(F.xxhash64("i", "t"), F.lit(passes))).mapInArrow(_counted, "slice long, words long, wide long, terms array<long>"), "items")
        total = counts.agg(F.count("*").alias("n"), F.avg("words").alias("mean"), F.max("wide").alias("wide")).first()
        spread = counts.select("slice", F.explode("terms").alias("term"))
        df = cut(spread.groupBy("term").count(), "item-terms")
    for p in range(passes):  # each index is bounded; a larger benchmark takes more passes
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p).orderBy("i", "t").collect()
        whole = None
        if passes > 1:
            held = df.join(spread.where(F.col("slice") == p).select("term").distinct(), "term").collect()
            held = sorted((np.int64(r["term"]).view(np.uint64), r["count"]) for r in held)
            whole = Whole(total["n"], total["mean"], np.array([x for x, _ in held], np.uint64), np.array([c for _, c in held], float))
        index = build([(r["i"], r["t"]) for r in own], whole)
        longest = total["wide"] or 2 if whole else max([2, *(_wide(q, a) for q, a in zip(index.question, index.answer, strict=True))])
        found = text.mapInArrow(_scan(spark.sparkContext.broadcast(index), max(passage, 2 * longest), threshold), "doc_id long, item_id long, word long, score double, question double, answer double, leak boolean")
        out = found if out is None else out.unionByName(found)
    return out


def _scan(sent, passage: int, threshold: float):
    names = ["doc_id", "item_id", "word", "score", "question", "answer", "leak"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            rows_out = []
            for lo, hi, h, rows, _ in _words(b.column(1)):
                best: dict[tuple[int, int], tuple] = {}
                first = np.searchsorted(rows, np.arange(hi - lo + 1))
                for row, word, item, score in passages(index, h, rows, hi - lo, passage, threshold):
                    a = first[row] + word
                    held = _runs_of(h[max(first[row], a - passage // 2) : min(first[row + 1], a + passage + passage // 2)])
                    q, s = _share(index.question[item], held), _share(index.answer[item], held)
                    new = (min(q / QUESTION, s / ANSWER), score, -word, q, s)
                    if new > best.get((row, item), (-1.0,)):
                        best[row, item] = new
                for (row, item), (_, score, word, q, s) in sorted(best.items()):
                    rows_out.append((b.column(0)[lo + row].as_py(), index.items[item], -word, score, q, s, q >= QUESTION and s >= ANSWER))
            cols = list(zip(*rows_out, strict=True)) if rows_out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def _runs_of(h: np.ndarray) -> np.ndarray:
    """Runs of 1 to RUN words: short questions and answers have fewer."""
    row = np.zeros(len(h), np.int64)
    return np.concatenate([X.shingles(h, row, 1, k)[0] for k in range(1, RUN + 1)])
