"""Text to segments with exact offsets: sections, sentences, clauses and lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.functions.text import tiles


SENTENCE = r"[^.!?\n]+(?:[.!?]+|\n+|$)"


def sentences(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, number, start, end, value): sentences without leading and trailing white space, empty ones left out."""
    t = docs.select(doc, F.posexplode(tiles(F.coalesce(F.col(text), F.lit("")), SENTENCE)).alias("number", "s"))
    lead = F.length(F.regexp_extract("s.value", r"^\s*", 0))
    body = F.regexp_replace(F.regexp_replace("s.value", r"^\s+", ""), r"\s+$", "")
    t = t.select(doc, (F.col("s.start") + lead).alias("start"), body.alias("value")).where("value <> ''")
    return t.select(doc, "start", (F.col("start") + F.length("value")).alias("end"), "value")


def lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line, start, end, value): every line with its offsets."""
    t = docs.select(doc, F.posexplode(tiles(F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")), r"[^\n]*\n")).alias("line", "s"))
    return t.select(doc, "line", F.col("s.start").alias("start"), (F.col("s.end") - 1).alias("end"), F.substr("s.value", F.lit(1), F.length("s.value") - 1).alias("value"))


def sections(docs: DataFrame, doc: str, text: str, rules: DataFrame, most: int | None = None) -> DataFrame:
    """Headings and the text under them: (doc, title, category, heading_start, start, end).

    ``rules`` (alias, category) match a line's beginning, after a number such as ``2.``, if a blank, colon or the
    line's end follows; the longest alias wins.  A document without headings is one section ``Document``.
    """
    ls = lines(docs, doc, text).withColumn("bare", F.lower(F.regexp_replace("value", r"^\s*(?:\d+[.)]\s*)*", "")))
    hit = ls.join(F.broadcast(rules.select("alias", "category")), F.col("bare").startswith(F.col("alias")))  # a list of headings
    hit = hit.where(F.substr("bare", F.length("alias") + 1, F.lit(1)).rlike(r"^(?:[\s:]|)$"))
    hit = hit.withColumn("_r", F.row_number().over(W.partitionBy(doc, "line").orderBy(F.desc(F.length("alias")), "alias"))).where("_r = 1")
    size = docs.select(doc, F.length(text).alias("size"))
    w = W.partitionBy(doc).orderBy("start")
    found = hit.join(size, doc).select(doc, F.col("alias").alias("title"), "category", F.col("start").alias("heading_start"), F.col("end").alias("begin"), F.coalesce(F.lead("start").over(w), F.col("size")).alias("stop"))
    stop = F.least("stop", F.col("begin") + most) if most else F.col("stop")
    found = found.select(doc, "title", "category", "heading_start", F.col("begin").alias("start"), stop.alias("end"))
    none = size.join(found, doc, "left_anti").select(doc, F.lit("Document").alias("title"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("int").alias("heading_start"), F.lit(0).alias("start"), F.col("size").alias("end"))
    return found.unionByName(none)


def nearest_parent(headings: DataFrame, doc: str, start: str, title: str, category: str, parents: list[str]) -> DataFrame:
    """``headings`` with the latest earlier title whose category may be a parent."""
    w = W.partitionBy(doc).orderBy(start).rowsBetween(W.unboundedPreceding, -1)
    return headings.withColumn("parent", F.last(F.when(F.col(category).isin(*parents), F.col(title)), ignorenulls=True).over(w))


def clauses(text: Column) -> Column:
    """Clauses of a text with offsets: bounded by line ends, stops, semicolons, colons and comma-blank."""
    return tiles(text, r"(?:(?!, )[^\n.;:!?])+")


def chunk_documents(docs: DataFrame, spans: DataFrame, doc: str, text: str, limit: int) -> DataFrame:
    """Training chunks near ``limit`` signs that cut no span: (doc, chunk, start, end).

    A chunk ends at the first blank from its limit on that lies in no span; one document is one row's work.
    """
    held = spans.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t, ss in zip(b[doc], b[text], b["spans"], strict=True):
                at, n, t = 0, 0, t or ""
                held_spans = [] if ss is None else [(s["start"], s["end"]) for s in ss]
                while at < len(t):
                    end = min(at + limit, len(t))
                    while end < len(t) and (not t[end].isspace() or any(s < end < e for s, e in held_spans)):
                        end += 1
                    out.append((d, n, at, end))
                    at, n = end, n + 1
            yield pd.DataFrame(out, columns=[doc, "chunk", "start", "end"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, text).join(held, doc, "left").mapInPandas(run, f"`{doc}` {kind}, chunk int, start int, end int")
