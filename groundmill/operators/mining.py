"""Building datasets: duplicates, consensus, inventories, co-occurrence, splits, gates and coverage."""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundmill.operators.rounds import cut


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and 24 hex digits of the hash of the parts, separated by a zero byte; nulls count as empty."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24))


def duplicate_groups(docs: DataFrame, doc: str, key: Column) -> DataFrame:
    """Documents with equal keys: (doc, group_key, canonical, copies); canonical is the least id."""
    keyed = docs.select(F.col(doc), F.sha2(key, 256).alias("group_key"))
    g = keyed.groupBy("group_key").agg(F.min(doc).alias("canonical"), F.count("*").alias("copies"))
    return keyed.join(g, "group_key")


def reconcile(groups: DataFrame, annotations: DataFrame, doc: str, item: list[str]) -> DataFrame:
    """Votes of exact copies on each annotation: ``silver`` if all copies have it, else ``review``."""
    votes = groups.join(annotations, doc).groupBy("group_key", "canonical", "copies", *item).agg(F.count_distinct(doc).alias("votes"))
    return votes.withColumn("tier", F.when(F.col("votes") == F.col("copies"), "silver").otherwise("review"))


def consensus(proposals: DataFrame, key: list[str], labeler: str, confidence: str, least: int = 2) -> DataFrame:
    """One vote per labeler (its largest confidence), then mean confidence, votes and tier of each key."""
    one = proposals.groupBy(*key, labeler).agg(F.max(confidence).alias("c"))
    return one.groupBy(*key).agg(F.count("*").alias("votes"), F.avg("c").alias("confidence")).withColumn("tier", F.when(F.col("votes") >= least, "silver").otherwise("bronze"))


def mention_inventory(mentions: DataFrame, key: str, label: str, doc: str, least: int = 1, documents: int = 2) -> DataFrame:
    """Occurrences and documents of each key and label, its number of labels, and its support tier."""
    per = mentions.groupBy(key, label, doc).agg(F.count("*").alias("n")).groupBy(key, label).agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))
    per = per.withColumn("labels", F.count("*").over(W.partitionBy(key))).where((F.col("occurrences") >= least) & (F.col("documents") >= documents))
    return per.withColumn("conflict", F.col("labels") > 1).withColumn("tier", F.when(F.col("documents") > 1, "multi_document").when(F.col("occurrences") > 1, "repeated_single_document").otherwise("singleton"))


def promote_aliases(proposals: DataFrame, known: DataFrame, occurrences: int = 2, documents: int = 2) -> DataFrame:
    """Alias proposals (alias, code, document): decision target_conflict, already_present, low_support or promoted."""
    per = proposals.groupBy("alias", "code").agg(F.count("*").alias("occurrences"), F.count_distinct("document").alias("documents"))
    targets = F.count("*").over(W.partitionBy("alias"))
    per = per.withColumn("targets", targets).join(known.select("alias", "code", F.lit(True).alias("present")), ["alias", "code"], "left")
    why = F.when(F.col("targets") > 1, "target_conflict").when(F.col("present"), "already_present").when((F.col("occurrences") < occurrences) | (F.col("documents") < documents), "low_support").otherwise("promoted")
    return per.withColumn("decision", why).drop("present")


def cooccurrence(items: DataFrame, context: str, doc: str, node: str, order: str, support: int = 2, gap: int | None = None, cap: int | None = None) -> DataFrame:
    """Pairs of different nodes in a context: support (documents) and occurrences, head the smaller node.

    ``gap`` bounds the distance of ``order``, ``cap`` the items of a context that take part (the policy's
    density limit, by order), so a context never pairs more than cap x cap items.
    """
    items = items.select(context, doc, node, order)
    if cap is not None:
        items = items.withColumn("_r", F.row_number().over(W.partitionBy(context).orderBy(order, node))).where(F.col("_r") <= cap).drop("_r")
    a = items.select(context, doc, F.col(node).alias("head"), F.col(order).alias("o1"))
    b = items.select(context, F.col(node).alias("tail"), F.col(order).alias("o2"))
    if gap is None:
        pairs = a.join(b, context).where("head < tail")
    else:  # stretches as wide as the gap: an equality on context and stretch, at most three of them an item
        at = lambda c: F.floor(F.col(c) / max(gap, 1)).cast("long")
        near = a.withColumn("_b", F.explode(F.sequence(at("o1") - 1, at("o1") + 1)))
        pairs = near.join(b.withColumn("_b", at("o2")), [context, "_b"]).where("head < tail").where(F.abs(F.col("o1") - F.col("o2")) <= gap)
    per = pairs.groupBy("head", "tail", doc).agg(F.count("*").alias("n"))
    return per.groupBy("head", "tail").agg(F.count("*").alias("support"), F.sum("n").alias("occurrences")).where(F.col("support") >= support)


def split_of(key: Column, salt: str, development: float = 0.1) -> Column:
    """``development`` or ``train`` by the first 32 bits of the hash of salt and key."""
    share = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.lit("\0"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967295
    return F.when(share < development, "development").otherwise("train")


def component_splits(members: DataFrame, component: str, challenge: str, salt: str, development: float = 0.1) -> DataFrame:
    """One split per component: challenge if any member is one, else by hash, so no component is cut."""
    c = members.groupBy(component).agg(F.max(F.col(challenge).cast("int")).alias("c"))
    c = c.withColumn("split", F.when(F.col("c") == 1, "challenge").otherwise(split_of(F.col(component), salt, development))).select(component, "split")
    return members.join(c, component)


def cross_split_overlap(rows: DataFrame, value: str, split: str) -> DataFrame:
    """Values in more than one split, with the splits."""
    return rows.select(value, split).distinct().groupBy(value).agg(F.array_sort(F.collect_list(split)).alias("splits")).where(F.size("splits") > 1)


def coverage(docs: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Observed rows per target cell (keys, target) and its gap: 1 less observed over target, at least 0."""
    seen = docs.groupBy(*keys).agg(F.count("*").alias("observed"))
    out = targets.join(seen, keys, "left").fillna(0, ["observed"])
    return out.withColumn("gap", F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("observed") / F.col("target"))))


def priority(df: DataFrame) -> Column:
    """The review priority of a row with gap, disagreement, novelty, density and quality."""
    del df
    return 0.30 * F.col("gap") + 0.25 * F.col("disagreement") + 0.20 * F.col("novelty") + 0.15 * F.col("density") + 0.10 * F.col("quality")


def reasons(rules: dict[str, Column]) -> Column:
    """The names of all rules that fire, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that fires, else null."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules.items()])


def merge_concepts(rows: DataFrame, key: str, order: str, scalars: list[str], arrays: list[str]) -> DataFrame:
    """One row per key: first scalars by order, arrays united in order, and whether scalars disagree."""
    w = F.array_sort(F.collect_list(F.struct(order, *arrays)))
    g = rows.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in scalars], w.alias("_all"), F.max(F.struct(*scalars)).alias("_hi"), F.min(F.struct(*scalars)).alias("_lo"))
    united = [F.array_distinct(F.flatten(F.transform("_all", _field(c)))).alias(c) for c in arrays]
    return g.select(key, *scalars, *united, (F.col("_hi") != F.col("_lo")).alias("conflict"))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def upsert_documents(rows: DataFrame, key: str, content: str, origin: str) -> DataFrame:
    """One row per key: content, sorted origins, and whether contents of the key differ."""
    return rows.groupBy(key).agg(F.min_by(content, F.struct(F.col(origin), F.col(content))).alias(content), F.array_sort(F.collect_set(origin)).alias("origins"), (F.min(F.sha2(content, 256)) != F.max(F.sha2(content, 256))).alias("conflict"))


def most_restrictive(rows: DataFrame, group: str, column: str, levels: list[str]) -> DataFrame:
    """The most restrictive value of each group; ``levels`` run from open to closed."""
    rank = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(column))
    return rows.groupBy(group).agg(F.max_by(column, rank).alias(column))


def synonym_pairs(aliases: DataFrame, concept: str, surface: str, surfaces: int = 8, pairs: int = 12) -> DataFrame:
    """Ordered pairs of a concept's first surfaces, at most ``pairs`` of them (the policy's limits)."""
    few = aliases.select(concept, surface).distinct().withColumn("i", F.row_number().over(W.partitionBy(concept).orderBy(surface))).where(F.col("i") <= surfaces)
    p = few.select(concept, F.col(surface).alias("left"), F.col("i").alias("a")).join(few.select(concept, F.col(surface).alias("right"), F.col("i").alias("b")), concept).where("a < b")
    p = p.withColumn("r", F.row_number().over(W.partitionBy(concept).orderBy("a", "b"))).where(F.col("r") <= pairs)
    return p.select(concept, "left", "right")


def first_lane(rows: DataFrame, text: str, lane_rank: str, key: str) -> DataFrame:
    """Each text once, from the first lane that has it (the least key within a lane)."""
    w = W.partitionBy(F.sha2(text, 256)).orderBy(lane_rank, key)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def repeated_instructions(rows: DataFrame, source: str, content: str, seed: str, most: int, repeat: str) -> DataFrame:
    """Per source the first ``most`` rows by seeded hash, equal contents once with their largest repeat, then repeated."""
    w = W.partitionBy(source).orderBy(F.sha2(F.concat(F.lit(seed), F.col(content)), 256))
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    once = few.groupBy(F.sha2(content, 256).alias("content_key")).agg(F.max(repeat).alias(repeat))
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(repeat))))


_WORD = re.compile(r"\w+")


def simhash64(text: str) -> int:
    """64 bits by majority over the hashed 3-word shingles of the folded text; ties give 1."""
    folded = " ".join(unicodedata.normalize("NFKC", text).casefold().split())
    w = [x.encode() for x in _WORD.findall(folded)]
    grams = [b" ".join(g) for g in zip(w, w[1:], w[2:])] or [b" ".join(w)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 14):
        hashed = b"".join([hashlib.blake2b(g, digest_size=8).digest() for g in grams[at : at + (1 << 14)]])
        ones += np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones >= len(grams)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _simhash(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else (h - (1 << 64) if (h := simhash64(x)) >= 1 << 63 else h)).astype("Int64")


def simhash_pairs(docs: DataFrame, doc: str, text: str, bands: int = 4, apart: int = 3) -> DataFrame:
    """Links (a, b, distance) between texts whose fingerprints differ in at most ``apart`` bits.

    A fingerprint is cut into one block more than ``bands``.  With more bands than bits that may differ, at least two blocks
    (``bands + 1 - apart``) are equal, so the join on every choice of so many blocks loses none; a pair counts in the first
    choice that it meets in.  Texts with one fingerprint are linked to the least of them only, so a group of copies gives no
    pairs.
    """
    sig = cut(docs.select(F.col(doc).alias("doc"), _simhash(text).alias("sig")).where("sig is not null"), "simhash")
    reps = sig.groupBy("sig").agg(F.min("doc").alias("doc"))
    blocks = bands + 1
    at = [64 * i // blocks for i in range(blocks + 1)]
    bits = [(1 << at[i + 1]) - (1 << at[i]) for i in range(blocks)]
    mask = lambda some: F.lit(m - (1 << 64) if (m := sum(bits[i] for i in some)) >= 1 << 63 else m).cast("long")
    choices = list(itertools.combinations(range(blocks), blocks - apart))
    keyed = reps.select("doc", "sig", F.posexplode(F.array(*[F.col("sig").bitwiseAND(mask(c)) for c in choices])).alias("choice", "value"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = a.join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.doc") < F.col("b.doc")))
    x = F.col("a.sig").bitwiseXOR(F.col("b.sig"))
    first = F.lit(False)
    for k, c in enumerate(choices):
        earlier = [x.bitwiseAND(mask([i])) != 0 for i in range(c[-1]) if i not in c]
        first = F.when(F.col("a.choice") == k, functools.reduce(operator.and_, earlier, F.lit(True))).otherwise(first)
    near = near.where((F.bit_count(x) <= apart) & first).select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b"), F.bit_count(x).cast("int").alias("distance"))
    same = sig.join(reps.withColumnRenamed("doc", "lead"), "sig").where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b"), F.lit(0).alias("distance"))
    return near.unionByName(same)


def recognition_knowledge(mentions: DataFrame, known: DataFrame, occurrences: int = 2, documents: int = 2, share: float = 0.9) -> DataFrame:
    """Surfaces good enough to be recognised: (norm, entity_type, occurrences, documents, share, decision).

    ``mentions``: norm, entity_type, doc; ``known``: norms of the dictionary.  A surface's leading type needs ``share`` of
    its mentions; the decision is already_known, ambiguous_type, low_support or accepted.
    """
    per = mentions.groupBy("norm", "entity_type", "doc").agg(F.count("*").alias("n")).groupBy("norm", "entity_type").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))
    top = per.groupBy("norm").agg(F.sum("occurrences").alias("_all"), F.max(F.struct("occurrences", "documents", "entity_type")).alias("t"))
    held = top.select("norm", "t.entity_type", "t.occurrences", "t.documents", F.round(F.col("t.occurrences") / F.col("_all"), 6).alias("share"))
    held = held.join(known.select("norm").distinct().withColumn("_k", F.lit(True)), "norm", "left")
    low = (F.col("occurrences") < occurrences) | (F.col("documents") < documents)
    why = F.when(F.col("_k"), "already_known").when(F.col("share") < share, "ambiguous_type").when(low, "low_support").otherwise("accepted")
    return held.withColumn("decision", why).drop("_k")
