"""N-gram Jaccard join by T-occurrence search with DivideSkip.

1. Texts become sets of hashed word shingles; texts with equal sets are one class, kept by its least id.
2. Exact routing.  Two sets of Jaccard p or more differ in at most D elements, D bounded by their sizes.
   Each set is cut into D + S parts by hash range, so S or more parts of such a pair are equal: a
   T-occurrence problem over lists of equal parts.  Texts with fewer than S shared parts are done; the
   others skip the S - 1 longest lists they are on, as DivideSkip does, and meet on the rest.  In a
   global order by length the shortest common list of a pair is never skipped.  Parts made of a
   frequent passage alone are the long lists, so such passages don't draw documents together.
   Components of these links (each list's members with its least one) hold every pair that can link.
3. Each component is searched by T-occurrence: inverted lists of its shingles, the L longest set aside,
   the short ones merged, documents reaching T - L probed in the long ones by binary search, and those
   reaching the required overlap retained.  A large component is dealt out as pairs of blocks, so no
   task gets an unbounded group.
4. Components of the retained links, found by star contraction, are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.llm import _text as X
from groundmill.llm._store import bounded, cut, release
from groundmill.llm.components import components

#: Shingles that one block of a component holds at most (if no single text has more).
BLOCK = 250_000
#: Ids up to this many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _edges(percent: int, top: int) -> np.ndarray:
    """Lower bounds of size classes: a set's partner of equal or larger size is in its class or the next."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * 100 // percent + 1)
    return np.array([*out, out[-1] * 100 // percent + 1, (out[-1] * 100 // percent + 1) * 100 // percent + 1])


def differences(percent: int, hi: int) -> int:
    """The most elements in which two sets of at most ``hi`` elements can differ and still link."""
    return (100 - percent) * 2 * hi // (100 + percent)


def spare(d: int) -> int:
    """How many equal parts are asked of two sets that differ in at most ``d`` elements."""
    return 2 + d // 4


def part_hashes(s: np.ndarray, percent: int, edges: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Hashes of a sorted set's parts for its own size class and the next larger one, and how many each must share.

    The two low bits of a hash tell the class: 0 own, 1 next, 2 and 3 pairs of empty parts, which stand in for equal
    parts that are empty where a set has so many that all shared ones may be.
    """
    n, out, need = len(s), [], [0, 0]
    own = int(np.searchsorted(edges, n, "right")) - 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(X.mix(s + np.uint64(0x632BE59BD9B4E019)), out=total[1:])
    high = s >> np.uint64(32)
    for k, family in enumerate((own, own + 1)):
        d = differences(percent, int(edges[family + 1]) - 1)
        if not d:
            continue
        m = d + spare(d)
        part = (high * np.uint64(m)) >> np.uint64(32)  # rises with s
        cuts = np.searchsorted(part, np.arange(m + 1, dtype=np.uint64))
        value = total[cuts[1:]] - total[cuts[:-1]]
        key = np.arange(m, dtype=np.uint64) + np.uint64(family << 32)
        full = cuts[1:] > cuts[:-1]
        empty = np.flatnonzero(~full)
        need[k] = max(1, spare(d) - len(empty))
        # the low bits name the family's parity, so both sets of a pair agree on them
        tag = np.uint64(family % 2)
        out.append((X.chain([X.mix(key + np.uint64(1)), value])[full] & ~np.uint64(3)) | tag)
        if len(empty) >= spare(d):
            ij = np.array(list(combinations(empty.tolist(), 2)), np.uint64)
            out.append((X.chain([X.mix(np.full(len(ij), (family << 32) + 7, np.uint64)), ij[:, 0], ij[:, 1] + np.uint64(0xE3)]) & ~np.uint64(3)) | tag | np.uint64(2))
    if own % 2:
        need.reverse()  # by the families' parity
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), need[0], need[1]


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, in order."""
    for lo, hi, data, off in X.pieces(column):
        low = X.LOWER[data]
        starts, ends, rows = X.words(low, off)
        h, row = X.shingles(X.word_hashes(low, starts, ends), rows, hi - lo, k)
        cuts = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield X.unique(h[cuts[i] : cuts[i + 1]])


def _sums(s: np.ndarray) -> tuple[int, int]:
    """Two sums of hashes that tell sets apart."""
    return int(X.mix(s).sum(dtype=np.uint64)), int(X.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def _digest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two = [], [], []
            for s in _sets(b.column(1), k):
                n.append(len(s))
                x, y = _sums(s)
                one.append(x)
                two.append(y)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64))], ["doc_id", "n", "h1", "h2"]
            )

    return run


def _own(k: int):
    """Of texts that share an id, those of the class asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = zip(b.column(2).to_numpy().view(np.uint64).tolist(), b.column(3).to_numpy().view(np.uint64).tolist(), strict=True)
            held = pa.array([_sums(s) == w for s, w in zip(_sets(b.column(1), k), want, strict=True)], pa.bool_())
            yield b.select([0, 1]).filter(held)

    return run


def _parts(percent: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(percent, 1 << 16)
        for b in batches:
            key = b.column(0).to_numpy()
            parts, rows, needs = [], [], []
            for i, s in enumerate(_sets(b.column(1), k)):
                if len(s) >= edges[-3]:
                    edges = _edges(percent, 2 * len(s))
                p, even, odd = part_hashes(s, percent, edges) if len(s) else (np.zeros(0, np.uint64), 0, 0)
                parts.append(p.view(np.int64))
                rows.append(np.full(len(p), i))
                needs.append((even, odd))
            if parts:
                row = np.concatenate(rows)
                need = np.array(needs, np.int16)
                part = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key[row]), pa.array(need[row, part & 1])], ["part", "rep", "need"])

    return run


def _packed_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s.tobytes() for s in _sets(b.column(1), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.large_binary()).cast(pa.binary())], ["rep", "set"])

    return run


def t_occurrence(sets: list[np.ndarray], queries: np.ndarray, targets: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the targets after it (or all, if the two are apart) that reach the threshold.

    DivideSkip (Li, Lu and Lu 2008): with T the least overlap that can do, any answer is on T - L of
    the lists besides the L longest.
    """
    k = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    own = np.repeat(np.arange(k), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    bound = np.concatenate([[0], np.cumsum(size)])
    held = np.zeros(k, bool)
    held[targets] = True
    inside = held[own]
    width = int(token.max()) + 1
    keys = np.sort(token[inside].astype(np.int64) * k + own[inside])  # the inverted lists, one after another
    begin = np.searchsorted(keys, np.arange(width + 1, dtype=np.int64) * k)
    length = np.diff(begin)
    same = len(queries) == len(targets) and bool((queries == targets).all())
    for q in queries:
        n = int(size[q])
        t = -(-percent * n // 100)
        mine = token[bound[q] : bound[q + 1]]
        lists = mine[np.argsort(length[mine], kind="stable")]
        longest = int(length[lists[-1]])
        if longest < 1 + same:
            continue
        away = min(t - 1, int(t / (0.0085 * np.log2(longest + 1) + 1)))
        short, long = lists[: n - away], lists[n - away :]
        some = short[length[short] > 0]
        lens = length[some]
        if not len(some):
            continue
        at = np.repeat(begin[some] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
        merged = np.sort(keys[at] % k, kind="stable")  # a merge of sorted runs
        first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        count = np.diff(np.concatenate([first, [len(merged)]]))
        found = merged[first]
        ok = (count >= t - away) & (size[found] * 100 >= percent * n) & (n * 100 >= percent * size[found])
        ok &= found > q if same else True
        found, count = found[ok], count[ok]
        if not len(found):
            continue
        long = long[length[long] > 0]
        if len(long):
            want = (long.astype(np.int64)[:, None] * k + found[None, :]).ravel()
            spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            count = count + (keys[spot] == want).reshape(len(long), -1).sum(0)
        hit = 100 * count >= percent * (n + size[found] - count)
        if hit.any():
            yield int(q), found[hit]


def _search(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list] = {}
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        pdf = pdf.sort_values(["comp", "rep"], kind="stable")
        for _, g in pdf.groupby("comp", sort=False):
            if len(g) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in g["set"]]
            ids, weight, block = g["rep"].to_numpy(), g["copies"].to_numpy(), g["block"].to_numpy()
            if g["one"].iloc[0] == g["two"].iloc[0]:
                a = b = np.arange(len(g))
            else:
                a, b = np.flatnonzero(block == g["one"].iloc[0]), np.flatnonzero(block == g["two"].iloc[0])
                if not len(a) or not len(b):
                    continue
            for q, found in t_occurrence(sets, a, b, percent):
                x = int(ids[q])
                for f in found:
                    y = int(ids[f])
                    out[x] = out.get(x, 0) + int(weight[f])
                    out[y] = out.get(y, 0) + int(weight[q])
                    rx, ry = root(x), root(y)
                    if rx != ry:
                        parent[max(rx, ry)] = min(rx, ry)
        return pd.DataFrame({"a": list(out), "b": [root(x) for x in out], "links": list(out.values())}, dtype="int64")

    return run


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, n_links).

    Words are runs outside [\\x20\\x09-\\x0D] after A-Z are lowered; a text's set has its distinct runs of
    ``k`` words, or its whole sequence if it has fewer.  Two texts link when their sets' Jaccard
    similarity is ``percent`` / 100 or more.  ``component_id`` is the least id reachable by links (its own
    for a text without links), ``n_links`` the number of other rows linked.  Null and empty texts have no
    shingles and no links.  Rows with equal id are kept and answered each, whether their texts are equal or not; a row with a null id is no class's
    representative and gets the component of the texts equal to its own, else null.  An empty table
    gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    one = cut(docs.mapInArrow(_digest(k), "doc_id long, n long, h1 long, h2 long"), "sets")
    key = ["n", "h1", "h2"]
    classes = one.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    again = cut(one.where("n > 0").groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    odd = not again.isEmpty()  # ids of several rows: their classes need a name of their own
    node = F.col("rep") if not odd else F.when(F.col("again"), F.xxhash64(*key)).otherwise(F.col("rep"))
    if odd:
        classes = classes.join(again.select(F.col("doc_id").alias("rep"), F.lit(True).alias("again")), "rep", "left")
        docs = docs.join(again, "doc_id", "left_anti").unionByName(docs.join(again, "doc_id", "left_semi").distinct())
    classes = cut(classes.withColumn("node", node).select(*key, "rep", "copies", "node"), "classes")

    def texts(nodes: DataFrame) -> DataFrame:
        """(node, text): one text of each class named."""
        if odd:
            own = docs.join(classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id"), "node", "h1", "h2"), "doc_id")
            return own.select("node", "text", "h1", "h2").mapInArrow(_own(k), "node long, text string")
        ids = nodes.select(F.col("node").alias("doc_id"))
        return docs.join(F.broadcast(ids) if bounded(ids, BROADCAST_IDS) else ids, "doc_id", "left_semi")

    named = classes.where("rep is not null")
    parts = texts(named.select("node")).mapInArrow(_parts(percent, k), "part long, rep long, need short").repartition("part")
    # the count reads all columns of the parts, so both sides of the join are one exchange
    shared = parts.groupBy("part").agg(F.count("*").alias("c"), F.max("need").alias("most"), F.min("rep").alias("first")).where("c > 1 and most >= 0 and first is not null")
    lists = parts.join(shared.select("part", "c").hint("shuffle_hash"), "part")
    mine = W.partitionBy("rep", F.col("part").bitwiseAND(F.lit(3)))
    kept = lists.withColumn("m", F.count("*").over(mine)).withColumn("r", F.row_number().over(mine.orderBy(F.desc("c"), F.desc("part"))))
    kept = kept.where(((F.col("m") >= F.col("need")) & (F.col("r") >= F.col("need"))) | (F.col("part").bitwiseAND(F.lit(2)) > 0))
    kept = cut(kept.select("part", "rep"), "lists")
    least = kept.groupBy("part").agg(F.min("rep").alias("lead"))
    star = kept.join(least, "part").where("rep <> lead").select("rep", "lead")
    comps = components(star, "rep", "lead")
    comps = cut(comps.join(named.select("node", "n", "copies"), "node"), "routes")
    release(kept)
    total = comps.groupBy("root").agg(F.sum("n").alias("total"))
    members = cut(
        comps.join(total, "root").select(
            F.col("node").alias("rep"), F.col("root").alias("comp"), "n", "copies",
            F.ceil(F.col("total") / block).cast("int").alias("blocks"),
        ),
        "members",
    )
    release(comps)
    sets = texts(members.select(F.col("rep").alias("node"))).mapInArrow(_packed_sets(k), "rep long, set binary")
    sets = members.join(sets, "rep").where(F.col("n") * 8 == F.octet_length("set"))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    groups = max(1, spark.conf.get("spark.sql.shuffle.partitions") and int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    dealt = dealt.select(
        "rep", "comp", "copies", "block", "set", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        F.when(F.col("blocks") > 1, F.col("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(groups))).alias("bin"),
        (F.col("blocks") > 1).alias("large"),
    )
    links = cut(dealt.groupBy("large", "bin", "one", "two").applyInPandas(_search(percent), "a long, b long, links long"), "links")
    release(members)
    found = components(links).select("node", "root")
    if odd:  # a class's name may be no id
        least = found.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("id"))
        found = found.join(least, "root").select("node", F.col("id").alias("root"))
    tally = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("more"))
    answer = cut(
        classes.join(found, "node", "left").join(tally, "node", "left").select(
            *key, F.coalesce("root", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("others")
        ),
        "answer",
    )
    for table in (links, classes, again):
        release(table)
    return one.join(answer, key, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("others", F.lit(0)).cast("long").alias("n_links"),
    )
