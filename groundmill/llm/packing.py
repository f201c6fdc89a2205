"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

Documents become token ids by a public tokenizer; each is cut into pieces, full windows first.  Pieces
are dealt by hash into groups of about GROUP_WINDOWS windows and at most about GROUP_PIECES pieces.  In a group every piece starts as a partial
partition of its own; the two with the largest spread are merged with opposing imbalances until one is
left, which gives windows of nearly equal size.  Whenever one exceeds the capacity, the window count
rises and the group is dealt again.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmill.llm import _text as X
from groundmill.llm._store import cut

WINDOW, PIECE, END, GROUP_WINDOWS = 4096, 1024, 2, 256
#: Pieces of a group at most, about: differencing holds a sum for each piece and window (100 MB at both bounds).
GROUP_PIECES = 16_384
#: Words kept with their ids in a worker; beyond it the memory starts anew.
CACHE = 400_000
#: Code points of White_Space (fixed values).
BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, BLANK, OTHER, SLOW = range(5)


class Tokenizer:
    """Ids of texts by a tokenizer file, each different word encoded once.

    The file's pre-tokenizer splits words without regard to their neighbours, so a text's ids are those
    of its words in turn.  Texts outside the common scripts, not in normal form, or with a special
    token's text go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.ids: dict[int, np.ndarray] = {}
        self._kinds()
        self._fresh()

    def _kinds(self) -> None:
        kind, fold = np.full(0x110000, SLOW, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for c in [*range(0x530), *range(0x1E00, 0x2070)]:
            ch = chr(c)
            cat, low = unicodedata.category(ch), ch.lower()
            kind[c] = LETTER if cat[0] == "L" else NUMBER if cat[0] == "N" else OTHER
            if len(low) > 1 or ch in "ΣςϹ" or cat == "Cn" or unicodedata.normalize("NFC", low) != low:
                kind[c] = SLOW
            else:
                fold[c] = ord(low)
        kind[BLANKS] = BLANK
        self.kind, self.fold = kind, fold

    def _fresh(self) -> None:
        self.known, self.begin, self.flat = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add the ids of new words, given in the order of their hashes."""
        new = [self._words(points, starts[k : k + 4096], ends[k : k + 4096]) for k in range(0, len(starts), 4096)]
        ids, each = (np.concatenate([x[k] for x in new]) for k in (0, 1))
        if len(self.known) > CACHE:
            self._fresh()
        lens = np.concatenate([np.diff(self.begin), each]).astype(np.int64)
        at = np.concatenate([self.begin[:-1], len(self.flat) + np.cumsum(each) - each]).astype(np.int64)
        flat = np.concatenate([self.flat, ids])
        key = np.concatenate([self.known, hashes])
        order = np.argsort(key, kind="stable")
        lens, at = lens[order], at[order]
        self.known = key[order]
        self.flat = flat[_ranges(at, lens)]
        self.begin = np.concatenate([[0], np.cumsum(lens)])

    def _words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and their number for each: all words as one text with blanks between, in one call.

        Where the tokenizer does not find just these words in that text, they are encoded one by one.
        """
        size = ends - starts + 1
        text = points[np.minimum(_ranges(starts, size), len(points) - 1)]
        text[np.cumsum(size) - 1] = 32
        text = text.tobytes().decode("utf-32-le")
        found = self.whole.encode(text, add_special_tokens=False)
        word, ids = np.array([-1 if w is None else w for w in found.word_ids], np.int64), np.array(found.ids, np.uint32)
        each = np.bincount(word[word >= 0], minlength=len(starts))
        if len(each) == len(starts) and each.all() and (word >= 0).all():
            return ids, each
        new = [[t.id for s, _ in self.whole.pre_tokenizer.pre_tokenize_str(w) for t in self.whole.model.tokenize(s)] for w in text[:-1].split(" ")]
        return np.array([i for x in new for i in x], np.uint32), np.array([len(x) for x in new], np.int64)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        for lo, hi, data, off in X.pieces(column, X.PIECE // 2):
            yield from self._piece(hi - lo, data, off)

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _piece(self, n: int, data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        raw = data.tobytes()
        text = raw.decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        at = lead[off]
        kind = self.kind[points]
        odd = np.concatenate([[0], np.cumsum(kind == SLOW)])
        slow = odd[at[1:]] > odd[at[:-1]]
        plain = unicodedata.is_normalized("NFC", text)
        special = "<|" in text
        if not plain or special:
            for i in range(n):
                part = text[at[i] : at[i + 1]]
                slow[i] |= not unicodedata.is_normalized("NFC", part) or "<|" in part
        fold = self.fold[points]
        starts, ends = self._split(kind, fold, at)
        rows = np.searchsorted(at, starts, "right") - 1
        keep = ~slow[rows]
        starts, ends, rows = starts[keep], ends[keep], rows[keep]
        h = _point_hashes(fold, starts, ends)
        words, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.known, words), max(0, len(self.known) - 1))
        missing = np.flatnonzero(self.known[spot] != words) if len(self.known) else np.arange(len(words))
        if len(missing):
            if len(self.known) + len(missing) > CACHE:
                self._fresh()
                missing = np.arange(len(words))
            self._learn(words[missing], fold, starts[first[missing]], ends[first[missing]])
            spot = np.searchsorted(self.known, words)
        lens = np.diff(self.begin)[spot][inverse] if len(words) else np.zeros(0, np.int64)
        flat = self.flat[_ranges(self.begin[:-1][spot][inverse], lens)] if len(words) else np.zeros(0, np.uint32)
        total = np.concatenate([[0], np.cumsum(lens)])
        cuts = total[np.searchsorted(rows, np.arange(n + 1))]
        for i in range(n):
            yield self._slow(text[at[i] : at[i + 1]]) if slow[i] else flat[cuts[i] : cuts[i + 1]]

    def _split(self, kind: np.ndarray, fold: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words: runs of letters, single numbers, runs of other signs, and the contractions."""
        if not len(kind):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        new[at[:-1][at[:-1] < len(kind)]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(kind))
        one = np.flatnonzero((ends - starts == 1) & (fold[starts] == 39))
        one = one[one + 1 < len(starts)]
        one = one[(kind[starts[one + 1]] == LETTER) & ~np.isin(starts[one + 1], at)]
        if len(one):
            c = fold[starts[one + 1]]
            d = np.where(ends[one + 1] - starts[one + 1] > 1, fold[np.minimum(starts[one + 1] + 1, len(fold) - 1)], 0)
            single = np.isin(c, [ord(x) for x in "stmd"])
            double = ((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l"))
            by = np.where(single, 1, np.where(double, 2, 0))
            ends[one] += by
            starts[one + 1] += by
        keep = (kind[starts.clip(max=len(kind) - 1)] != BLANK) & (ends > starts)
        return starts[keep], ends[keep]


def _ranges(begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each run, one after another."""
    total = np.concatenate([[0], np.cumsum(lens)])
    return np.repeat(begin - total[:-1], lens) + np.arange(int(total[-1]))


def _point_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, inverse = X._powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * p[: len(points)], out=total[1:])
    return X.mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_LOADED: dict[str, Tokenizer] = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str, end: int = END, window: int = WINDOW, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, row[, ids]): each document's ids and ``end``, cut into pieces.

    ``tokenizer`` is the path of a tokenizers file, the same on all machines.  A null text counts as
    empty: it has the end id alone.  ``row`` counts the rows of a task, so repeated rows differ.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, row = _tokenizer(tokenizer), 0
        for b in batches:
            key, out, kept = b.column(0).to_pylist(), [], []
            for i, x in zip(key, t.encode(b.column(1)), strict=True):
                row += 1
                x = np.append(x, np.uint32(end)).astype("<u4")
                full = len(x) // window * window
                for at in [*range(0, full, window), *range(full, len(x), piece)]:
                    part = x[at : min(at + (window if at < full else piece), len(x))]
                    out.append((i, at, len(part), zlib.crc32(part.tobytes()), len(x), row))
                    if ids:
                        kept.append(part.astype(np.int32))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols]
            if ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", *["ids"] * ids])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each size by Karmarkar-Karp differencing of k-way partial partitions."""
    n = len(sizes)
    sums = np.zeros((2 * n - 1, k), np.int64)  # slots in falling order
    sums[:n, 0] = sizes
    merged: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        new = n + len(merged)
        sums[new] = both[order]
        merged.append((a, b, order))
        heapq.heappush(heap, (-int(sums[new, 0] - sums[new, -1]), new))
    label: dict[int, np.ndarray] = {2 * n - 2: np.arange(k)}
    out = np.zeros(n, np.int64)
    for m in range(len(merged) - 1, -1, -1):
        mine = label.pop(n + m)
        a, b, order = merged[m]
        for node, slots in ((a, order), (b, k - 1 - order)):
            x = np.empty(k, np.int64)
            x[slots] = mine
            if node < n:
                out[node] = x[0]
            else:
                label[node] = x
    if n == 1:
        out[0] = 0
    return out


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each size with none over capacity: the count rises from the least possible one."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, k)
        if np.bincount(found, sizes, k).max() <= capacity:
            return found
        k += 1


def _pack(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32", "row"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        size = pdf["length"].to_numpy()
        seq = np.zeros(len(pdf), np.int64)
        full = int((size >= window).sum())
        seq[:full] = np.arange(full)
        if full < len(pdf):
            seq[full:] = full + windows(size[full:], window)
        order = np.argsort(seq, kind="stable")
        total = np.concatenate([[0], np.cumsum(size[order])])[:-1]
        first = np.concatenate([[True], seq[order][1:] != seq[order][:-1]])
        offset = np.empty(len(pdf), np.int64)
        offset[order] = total - np.maximum.accumulate(np.where(first, total, 0))
        pdf["sequence_id"] = (pdf["part"].to_numpy() << 32) + seq
        pdf["offset"] = offset
        return pdf.drop(columns=["part", "row"])

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = END, window: int = WINDOW, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids and the end id; each lies in exactly one piece, and pieces fill sequences of at
    most ``window`` from offset 0 without gaps.  Null texts count as empty; repeated rows and null ids
    are packed like any other row; other columns are ignored; an empty table gives an empty result.
    """
    pieces = cut(tokenize_pieces(docs, tokenizer, end, window, piece, id_col, text_col), "pieces")
    tokens, n = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    parts = max(1, round(tokens / (window * GROUP_WINDOWS)), -(-n // GROUP_PIECES))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(parts)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("part").applyInPandas(_pack(window), schema)
