"""Spans from text: dictionary automata, patterns, BIO labels, abbreviations, and choosing among overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Aliases up to this many make one broadcast automaton; larger dictionaries are searched in several passes.
AUTOMATON = 500_000


def _plain(text: str) -> str:
    import unicodedata

    out = []
    for c in text:
        n = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").replace("đ", "d").replace("Đ", "D").lower()
        out.append(n if len(n) == 1 else c.lower() if len(c.lower()) == 1 else c)
    return "".join(out)


def _lower(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def dictionary_matches(docs: DataFrame, aliases: DataFrame, doc: str, text: str, boundaries: bool = True, least: int = 2, toneless_least: int = 8) -> DataFrame:
    """All dictionary spans: (doc, concept_id, start, end, alias, exact).

    One automaton holds exact keys, one keys without diacritics (of ``toneless_least`` characters or more
    and different from the exact one).  A match needs no word character before it and none after it,
    but an upper-case one may follow unless the alias is all upper case.  Keys keep one character per
    character of the text, so automaton positions are offsets.
    """
    spark = docs.sparkSession
    rows = aliases.select("concept_id", "alias").where(F.length("alias") >= least).distinct()
    passes = max(1, -(-rows.count() // AUTOMATON))
    out = None
    kind = f"`{doc}` {docs.schema[doc].dataType.simpleString()}, concept_id {aliases.schema['concept_id'].dataType.simpleString()}, start int, end int, alias string, exact boolean"
    for p in range(passes):
        own = rows.where(F.pmod(F.xxhash64("alias"), F.lit(passes)) == p).collect()  # at most about AUTOMATON rows
        sent = spark.sparkContext.broadcast([(r["concept_id"], r["alias"]) for r in own])
        found = docs.select(doc, text).mapInPandas(_matcher(sent, doc, text, boundaries, toneless_least), kind)
        out = found if out is None else out.unionByName(found)
    return out


def _matcher(sent, doc: str, text: str, boundaries: bool, toneless_least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        exact, bare = {}, {}
        for cid, alias in sent.value:
            exact.setdefault(_lower(alias), []).append((cid, alias))
            key = _plain(alias)
            if len(key) >= toneless_least and key != _lower(alias) and alias != alias.upper():
                bare.setdefault(key, []).append((cid, alias))
        machines = []
        for table in (exact, bare):
            m = ahocorasick.Automaton()
            for k, v in table.items():
                m.add_word(k, (len(k), v))
            if table:
                m.make_automaton()
            machines.append((m, bool(table)))
        word = re.compile(r"\w")
        for b in batches:
            found: dict[tuple, tuple] = {}
            for d, t in zip(b[doc], b[text], strict=True):
                t = t or ""
                for (m, some), fold, is_exact in zip(machines, (_lower, _plain), (True, False), strict=True):
                    if not some:
                        continue
                    for last, (size, v) in m.iter(fold(t)):
                        s, e = last - size + 1, last + 1
                        if boundaries and s and word.match(t[s - 1]):
                            continue
                        for cid, alias in v:
                            if boundaries and e < len(t) and word.match(t[e]) and (not t[e].isupper() or alias == alias.upper()):
                                continue
                            found.setdefault((d, cid, s, e), (alias, is_exact))
            yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=[doc, "concept_id", "start", "end", "alias", "exact"])

    return run


def token_matches(tokens: DataFrame, aliases: DataFrame, doc: str, token: str) -> DataFrame:
    """Single-token dictionary matches as an equi-join, for dictionaries of any size."""
    return tokens.join(aliases, tokens[token] == aliases["alias"]).select(doc, "concept_id", token)


def schedule(spans: list[tuple[int, int, float]]) -> list[int]:
    """Indices of a non-overlapping set of greatest total weight; ties prefer more cover, then fewer spans."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0], i))
    ends = [spans[i][1] for i in order]
    best: list[tuple] = [((0.0, 0, 0), None, 0)]
    for k, i in enumerate(order):
        s, e, w = spans[i]
        p = int(np.searchsorted(ends[:k], s, "right"))
        t = best[p][0]
        take = (round(t[0] + w, 9), t[1] + e - s, t[2] - 1)
        best.append((take, i, p) if take > best[k][0] else (best[k][0], None, k))
    out, k = [], len(order)
    while k:
        _, i, p = best[k]
        if i is not None:
            out.append(i)
        k = p
    return out[::-1]


def resolve_weighted(spans: DataFrame, doc: str, weight: str = "weight") -> DataFrame:
    """``spans`` (doc, start, end, weight, ...) kept by weighted interval scheduling within each overlap island.

    Islands of overlapping spans are independent, so the dynamic programme runs on one island at a time,
    not on a whole document.
    """
    def chosen(rows: list) -> list[int]:
        rows = sorted(rows, key=lambda r: (r.start, r.end))
        return [rows[i].Index for i in schedule([(r.start, r.end, getattr(r, weight)) for r in rows])]

    alone = F.col(weight) >= 0
    return per_island(spans, doc, chosen, alone)


def per_island(spans: DataFrame, doc: str, chosen, alone: Column | bool = True) -> DataFrame:
    """``spans`` that ``chosen`` keeps of each overlap island (a list of rows to the indices kept).

    A span that overlaps no other stays in the JVM and is kept if ``alone`` holds; the others are dealt by island into
    groups that are many times the tasks, so no task gets an unbounded share.
    """
    from groundmill.operators.relations import overlap_islands

    cut = overlap_islands(spans, [doc]).withColumn("_n", F.count("*").over(W.partitionBy(doc, "island")))
    tasks = 4 * int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.where("_n > 1").withColumn("_bin", F.pmod(F.xxhash64(doc, "island"), F.lit(tasks)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        islands: dict[tuple, list] = {}
        for r in pdf.itertuples():
            islands.setdefault((getattr(r, doc), r.island), []).append(r)
        return pdf.loc[[i for rows in islands.values() for i in chosen(rows)]].drop(columns=["_n", "_bin"])

    many = dealt.groupBy("_bin").applyInPandas(run, cut.drop("_n").schema)
    return cut.where((F.col("_n") == 1) & alone).drop("_n").unionByName(many).drop("island")


def match_weight(length: Column, drug: Column, exact: Column) -> Column:
    """The weight of a dictionary match: its length, twice for drugs, else 4 more, and 2 for an exact one."""
    return length + F.when(drug, length).otherwise(4) + F.when(exact, 2).otherwise(0)


def proposal_utility(score: Column, sources: Column, atomic: Column, nested: Column) -> Column:
    """Log-odds of the score, a quarter per further source, 1.5 for an atomic product, 2.5 per nested span."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), score))
    return F.log(p / (1 - p)) + 0.25 * (sources - 1) + F.when(atomic, 1.5).otherwise(0.0) + 2.5 * nested


def merge_proposals(proposals: DataFrame, doc: str) -> DataFrame:
    """Equal (doc, start, end, type) proposals as one: best score, sources and their number."""
    return proposals.groupBy(doc, "start", "end", "type").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources")).withColumn("n_sources", F.size("sources"))


def greedy_overlap(gold: DataFrame, pred: DataFrame, doc: str) -> DataFrame:
    """One-to-one matches of overlapping spans per document, largest overlap first, then the closest lengths and places."""
    a = gold.select(doc, F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("type").alias("gt"))
    b = pred.select(doc, F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("type").alias("pt"))
    over = a.join(b, doc).where("gs < pe and ps < ge and gt = pt")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        o = np.minimum(pdf["ge"], pdf["pe"]) - np.maximum(pdf["gs"], pdf["ps"])
        d = (pdf["ge"] - pdf["gs"] - pdf["pe"] + pdf["ps"]).abs()
        order = np.lexsort((pdf["pe"], pdf["ps"], pdf["ge"], pdf["gs"], d, -o))
        g, p, keep = set(), set(), []
        for i in order:
            x, y = (pdf["gs"].iat[i], pdf["ge"].iat[i]), (pdf["ps"].iat[i], pdf["pe"].iat[i])
            if x not in g and y not in p:
                g.add(x)
                p.add(y)
                keep.append(i)
        return pdf.iloc[keep]

    return over.groupBy(doc, "gt").applyInPandas(run, over.schema)


def best_assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total weight, each row and column once, only pairs above 0.

    Shortest augmenting paths with potentials, on the matrix padded to a square.
    """
    n = max(weights.shape, default=0)
    if not n or not weights.size:
        return []
    cost = np.zeros((n, n))
    cost[: weights.shape[0], : weights.shape[1]] = -weights
    u, v, way, mate = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        mate[0], j0 = i, 0
        low, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            slack = cost[mate[j0] - 1] - u[mate[j0]] - v[1:]
            better = ~used[1:] & (slack < low[1:])
            low[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, low[1:]))) + 1
            delta = low[j1]
            u[mate[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if not mate[j0]:
                break
        while j0:
            mate[j0] = mate[way[j0]]
            j0 = way[j0]
    return sorted((int(mate[j]) - 1, j - 1) for j in range(1, n + 1) if mate[j] <= weights.shape[0] and j <= weights.shape[1] and weights[mate[j] - 1, j - 1] > 0)


def decode_bio(tokens: DataFrame, doc: str, position: str, label: str) -> DataFrame:
    """Spans from BIO or BIOES labels: (doc, type, first, last); an inside label without a beginning opens a span."""
    w = W.partitionBy(doc).orderBy(position)
    tag, kind = F.substring(label, 1, 1), F.substring(label, 3, 1000)
    t = tokens.select(doc, position, tag.alias("tag"), F.when(F.col(label) != "O", kind).alias("type"))
    t = t.withColumn("pt", F.lag("type").over(w)).withColumn("ptag", F.lag("tag").over(w))
    opens = F.col("type").isNotNull() & (F.col("tag").isin("B", "S") | F.col("pt").isNull() | (F.col("pt") != F.col("type")) | F.col("ptag").isin("E", "S"))
    t = t.withColumn("span", F.sum(opens.cast("int")).over(w)).where("type is not null")
    return t.groupBy(doc, "span", "type").agg(F.min(position).alias("first"), F.max(position).alias("last")).drop("span")


_PAREN = re.compile(r"\(([^()]{2,12})\)")


def _long_form(short: str, before: str) -> str | None:
    """The words before a bracket that spell its letters, read backwards, the first letter beginning a word."""
    i, j = len(short) - 1, len(before) - 1
    low, text = short.lower(), before.lower()
    while i >= 0:
        if not low[i].isalnum():
            i -= 1
            continue
        while j >= 0 and (text[j] != low[i] or (i == 0 and j > 0 and text[j - 1].isalnum())):
            j -= 1
        if j < 0:
            return None
        i -= 1
        j -= 1
    found = before[j + 1 :].strip()
    return found if len(found) > len(short) and len(found.split()) <= min(len(short) + 5, 2 * len(short)) else None


def abbreviations(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Definitions such as ``long form (LF)`` or ``LF (long form)``: (doc, abbreviation, expansion)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t in zip(b[doc], b[text], strict=True):
                for m in _PAREN.finditer(t or ""):
                    inside, before = m[1].strip(), (t[max(0, m.start() - 120) : m.start()]).rstrip()
                    if inside[:1].isalnum() and sum(c.isupper() for c in inside) >= 2 and " " not in inside:
                        full = _long_form(inside, re.split(r"[.;:\n]", before)[-1])
                        if full:
                            out.append((d, inside, full))
            yield pd.DataFrame(out, columns=[doc, "abbreviation", "expansion"])

    return docs.select(doc, text).mapInPandas(run, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, abbreviation string, expansion string")


def abbreviation_table(found: DataFrame, doc: str, documents: int = 1) -> DataFrame:
    """One expansion per abbreviation: support and whether several expansions conflict."""
    g = found.groupBy("abbreviation", F.lower("expansion").alias("expansion")).agg(F.count_distinct(doc).alias("documents"))
    return g.withColumn("conflict", F.count("*").over(W.partitionBy("abbreviation")) > 1).where(F.col("documents") >= documents)
