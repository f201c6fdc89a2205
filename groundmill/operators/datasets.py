"""Building and judging datasets: training pairs and queries, manifests, reviews, vector records, audits and scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundmill.operators.mining import content_id


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def accuracy_at_1(gold: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    """One row: coded gold spans, how many have the same code at the same span, and their share."""
    p = pred.groupBy(*key).agg(F.max("code").alias("_code"))
    held = gold.where("code is not null").join(p, key, "left")
    hit = F.count(F.when(F.col("_code") == F.col("code"), 1))
    return held.agg(F.count("*").alias("total"), hit.alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def attribute_metrics(gold: DataFrame, pred: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """Per attribute: tp, fp, fn, tn, precision, recall and f1 over spans that both have; one pass over the matches."""
    held = gold.select(*key, F.col("statuses").alias("_g")).join(pred.select(*key, F.col("statuses").alias("_p")), key)
    each = held.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.array_contains("_g", a).alias("g"), F.array_contains("_p", a).alias("p")) for a in attributes])).alias("x")).select("x.*")
    count = lambda g, p, n: F.count(F.when((F.col("g") == g) & (F.col("p") == p), 1)).alias(n)
    t = each.groupBy("attribute").agg(count(True, True, "tp"), count(False, True, "fp"), count(True, False, "fn"), count(False, False, "tn"))
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def compare_runs(runs: DataFrame, stages: DataFrame, baseline: str) -> DataFrame:
    """Each run against the baseline: throughput ratio, equal output, and its slowest stage.

    ``runs``: name, documents_per_second, output_sha256; ``stages``: name, stage, total_ms.
    """
    base = runs.where(F.col("name") == baseline).select(F.col("documents_per_second").alias("_rate"), F.col("output_sha256").alias("_sha"))
    top = stages.groupBy("name").agg(F.min_by("stage", F.struct((-F.col("total_ms")).alias("t"), "stage")).alias("bottleneck"))
    held = runs.join(F.broadcast(base)).join(top, "name", "left")
    same = F.coalesce((F.col("_sha") == F.col("output_sha256")), F.lit(False))
    return held.select("name", "documents_per_second", F.round(F.col("documents_per_second") / F.col("_rate"), 6).alias("throughput_ratio"), same.alias("same_output"), "bottleneck")


def flatten_metrics(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as columns named by their path."""

    def leaves(kind: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in kind.fields:
            out += leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [(*path, f.name)]
        return out

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in leaves(df.schema, ())])


def rank_report(answers: DataFrame, expected: DataFrame, by: list[str], cutoffs: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Per group: queries, mean reciprocal rank and recall at each cutoff of the first expected code.

    ``answers``: query_id, code, rank; ``expected``: query_id, code and the columns ``by``; several codes may be expected.
    """
    codes = answers.groupBy("query_id", "code").agg(F.min("rank").alias("rank"))
    w = W.partitionBy("query_id").orderBy("rank", "code")
    codes = codes.withColumn("rank", F.row_number().over(w))
    first = expected.select("query_id", "code").join(codes, ["query_id", "code"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    asked = expected.select("query_id", *by).distinct().join(first, "query_id", "left")
    at = [F.round(F.avg((F.coalesce(F.col("first"), F.lit(1 << 30)) <= k).cast("int")), 6).alias(f"recall_at_{k}") for k in cutoffs]
    return asked.groupBy(*by).agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), *at)


def candidate_orders(candidates: DataFrame, seed: int = 0) -> DataFrame:
    """(query_id, order, place, candidate): each query's candidates as retrieved, reversed, and shuffled by a stable hash."""
    w = W.partitionBy("query_id")
    n = F.count("*").over(w)
    shuffled = F.row_number().over(w.orderBy(F.sha2(F.concat_ws("\0", F.lit(seed), F.col("query_id"), F.col("candidate")), 256)))
    held = candidates.withColumn("_n", n).withColumn("_s", shuffled)
    orders = F.array(*[F.struct(F.lit(o).alias("order"), p.cast("int").alias("place")) for o, p in (("retrieval", F.col("rank")), ("reverse", F.col("_n") + 1 - F.col("rank")), ("shuffled", F.col("_s")))])
    return held.select("query_id", "candidate", F.explode(orders).alias("o")).select("query_id", "o.order", "o.place", "candidate")


def listwise_report(scores: DataFrame, abstained: DataFrame) -> DataFrame:
    """One row over queries: mean reciprocal rank of the best positive, mean Jaccard of the emitted set, abstentions caught.

    ``scores``: query_id, candidate (its index), score, positive.  The top candidate is emitted unless the query abstains.
    """
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "candidate")))
    per = ranked.groupBy("query_id").agg(F.min(F.when(F.col("positive"), F.col("rank"))).alias("best"), F.count(F.when(F.col("positive"), 1)).alias("positives"))
    per = per.join(abstained.select("query_id").distinct().withColumn("out", F.lit(True)), "query_id", "left").withColumn("out", F.coalesce("out", F.lit(False)))
    top = F.col("best") == 1
    union = F.col("positives") + F.when(F.col("out") | top, 0).otherwise(1)
    jaccard = F.when(union == 0, 1.0).otherwise(F.when(top & ~F.col("out"), 1).otherwise(0) / union)
    return per.agg(
        F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(jaccard), 6).alias("jaccard"),
        F.count(F.when(F.col("out"), 1)).alias("abstained"), F.count(F.when(F.col("out") & ~F.coalesce(top, F.lit(False)), 1)).alias("errors_caught"),
    )


def merge_abbreviations(baseline: DataFrame, mined: DataFrame) -> DataFrame:
    """(norm, surface, expansions, layers): both tables of (surface, norm, expansion, expansion_norm) without losing ambiguity.

    The baseline's spelling wins, then the least; an expansion counts once by its normal form.
    """
    both = baseline.withColumn("layer", F.lit("baseline")).unionByName(mined.withColumn("layer", F.lit("mined"))).where("trim(surface) <> '' and trim(expansion) <> ''")
    order = F.struct("layer", "expansion")
    one = both.groupBy("norm", "expansion_norm").agg(F.min_by("expansion", order).alias("expansion"), F.min_by("surface", F.struct("layer", "surface")).alias("surface"), F.min("layer").alias("first"), F.collect_set("layer").alias("layers"))
    return one.groupBy("norm").agg(
        F.min_by("surface", F.struct("first", "surface")).alias("surface"), F.transform(F.array_sort(F.collect_list(F.struct("expansion_norm", "expansion"))), lambda x: x["expansion"]).alias("expansions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("layers")))).alias("layers"),
    )


def proposal_queries(proposals: DataFrame, known: DataFrame) -> DataFrame:
    """Held-out queries from linked proposals: (norm, entity_type, code_system, codes, slices).

    ``slices``: ambiguous or unique, and whether the alias, the code or neither is known to the reference (leakage).
    """
    key = ["norm", "entity_type", "code_system"]
    alias = known.select("norm", "code_system").distinct().withColumn("_alias", F.lit(True))
    code = known.select("code_system", "code").distinct().withColumn("_code", F.lit(True))
    per = proposals.select(*key, "code").distinct().join(code, ["code_system", "code"], "left").groupBy(*key).agg(F.array_sort(F.collect_set("code")).alias("codes"), F.max(F.coalesce("_code", F.lit(False))).alias("_code"))
    held = per.join(alias, ["norm", "code_system"], "left")
    slices = F.array(F.when(F.size("codes") > 1, "ambiguous").otherwise("unique"), F.when(F.col("_alias"), "seen_alias").when(F.col("_code"), "seen_code").otherwise("unseen"))
    return held.select(*key, "codes", slices.alias("slices"), content_id("query", *[F.col(k) for k in key]).alias("query_id"))


def synonym_examples(pairs: DataFrame, concepts: DataFrame, most: int = 8) -> DataFrame:
    """(pair_id, negatives): the hardest other concepts' names for each pair, by shared words.

    Score: thrice the Jaccard of the word sets, and a half for an equal type.  Only concepts that share a word are met,
    by a join on words; concepts of one name are represented by the least id, so a common name counts once.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    names = concepts.groupBy("name", "semantic_type").agg(F.min("concept_id").alias("concept_id")).withColumn("words", words(F.col("name")))
    asked = pairs.select("pair_id", F.col("concept_id").alias("_own"), F.col("semantic_type").alias("_type"), words(F.col("left")).alias("_asked"), F.col("left").alias("_left"))
    keys = asked.groupBy("_asked", "_type", "_left").agg(F.collect_set("_own").alias("_owns"))
    met = keys.select("*", F.explode("_asked").alias("word")).join(names.select("*", F.explode("words").alias("word")), "word")
    met = met.groupBy("_left", "_type", "concept_id", "name", "semantic_type").agg(F.count("*").alias("n"), F.first(F.size("_asked")).alias("a"), F.first(F.size("words")).alias("b"), F.first("_owns").alias("_owns"))
    score = 3.0 * F.col("n") / (F.col("a") + F.col("b") - F.col("n")) + F.when(F.col("semantic_type") == F.col("_type"), 0.5).otherwise(0.0)
    own = concepts.select("concept_id", F.col("name").alias("_own_name")).distinct()
    held = asked.join(met.select("_left", "_type", "concept_id", "name", F.round(score, 9).alias("score")), ["_left", "_type"]).join(own.withColumnRenamed("concept_id", "_own"), "_own")
    held = held.where("name <> _own_name").withColumn("_r", F.row_number().over(W.partitionBy("pair_id").orderBy(F.desc("score"), F.lower("name"), "concept_id"))).where(F.col("_r") <= most)
    return held.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]).alias("negatives"))


def annotation_manifest(annotations: DataFrame, key: str = "annotation_id") -> DataFrame:
    """One row per id with ``conflict``: whether rows of the id differ; sorted output is left to the writer."""
    rest = [c for c in annotations.columns if c != key]
    per = annotations.groupBy(key).agg(F.count_distinct(F.struct(*rest)).alias("_n"), F.min(F.struct(*rest)).alias("_v"))
    return per.select(key, "_v.*", (F.col("_n") > 1).alias("conflict"))


REVIEW_SCHEMA = "review-queue.v1"


def export_review(documents: DataFrame, annotations: DataFrame, doc: str = "document_id", text: str = "text") -> DataFrame:
    """(value): one JSON line per document with its proposals, sorted by place."""
    items = [c for c in annotations.columns if c != doc]
    order = F.struct("start", "end", "annotation_id", *[c for c in items if c not in ("start", "end", "annotation_id")])
    per = annotations.groupBy(doc).agg(F.array_sort(F.collect_list(order)).alias("proposals"))
    none = F.array().cast(per.schema["proposals"].dataType)
    row = F.struct(F.lit(REVIEW_SCHEMA).alias("schema"), doc, F.col(text).alias("text"), F.coalesce("proposals", none).alias("proposals"))
    return documents.join(per, doc, "left").select(F.to_json(row).alias("value"))


def import_review(rows: DataFrame, kind: str, doc: str = "document_id") -> DataFrame:
    """The proposals of exported lines with ``issue``: unsupported_schema, duplicate_annotation or null.

    ``kind`` is the DDL type of one proposal, such as ``struct<annotation_id:string,start:int,end:int,type:string>``.
    """
    j = rows.select(F.from_json("value", f"struct<schema:string,{doc}:string,text:string,proposals:array<{kind}>>").alias("j")).select("j.*")
    each = j.select(doc, "schema", F.explode("proposals").alias("p")).select(doc, "schema", "p.*")
    n = F.count("*").over(W.partitionBy("annotation_id"))
    return each.withColumn("issue", F.when(F.col("schema") != REVIEW_SCHEMA, "unsupported_schema").when(n > 1, "duplicate_annotation")).drop("schema")


def vector_records(aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """(record_id, concept_id, entity_type, code_system, norm): the distinct names of each concept, once per normal form."""
    held = aliases.where("norm <> ''").select("concept_id", "norm").distinct().join(concepts.select("concept_id", F.col("semantic_type").alias("entity_type"), "code_system"), "concept_id")
    return held.withColumn("record_id", content_id("synonym", F.col("concept_id"), F.col("norm")))


def write_vector_shards(records: DataFrame, vectors: DataFrame, path: str) -> None:
    """Unit vectors of the records, one folder per type and code system."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = vectors.withColumn("vector", F.transform("vector", lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)))
    records.join(unit, "record_id").write.mode("overwrite").partitionBy("entity_type", "code_system").option("compression", "zstd").parquet(path)


def best_per_concept(hits: DataFrame, query: str = "query_id", limit: int = 20) -> DataFrame:
    """Hits on names reduced to concepts: the best score of each, at most ``limit`` a query."""
    best = hits.groupBy(query, "concept_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), "concept_id"))).where(F.col("rank") <= limit)


def release_rows(names: DataFrame, allowed: list[str], order: dict[str, int]) -> DataFrame:
    """One concept per code of a release's name table (code, name, tty, suppressed): the best term type's name is canonical.

    Ties go to the least name; the other names are aliases.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("tty")), F.lit(99))
    kept = names.where(F.col("tty").isin(allowed) & ~F.col("suppressed")).groupBy("code", "name").agg(F.min(F.struct(rank.alias("rank"), "tty")).alias("t"))
    per = kept.groupBy("code").agg(F.min(F.struct("t", "name")).alias("top"), F.array_sort(F.collect_set("name")).alias("names"))
    return per.select("code", F.col("top.name").alias("canonical_name"), F.col("top.t.tty").alias("tty"), F.array_remove("names", F.col("top.name")).alias("aliases"))


def release_profile(names: DataFrame) -> DataFrame:
    """Per term type: rows, codes, suppressed rows and distinct names."""
    return names.groupBy("tty").agg(F.count("*").alias("rows"), F.count_distinct("code").alias("codes"), F.count(F.when(F.col("suppressed"), 1)).alias("suppressed"), F.count_distinct(F.lower("name")).alias("names"))


def dataset_audit(documents: DataFrame, annotations: DataFrame, doc: str = "document_id") -> DataFrame:
    """One row of counts: documents, repeated ids and texts, empty texts, annotations, orphans, offsets that fail, overlaps."""
    d = documents.agg(F.count("*").alias("documents"), F.count_distinct(doc).alias("_ids"), F.count_distinct(F.sha2("text", 256)).alias("_texts"), F.count(F.when(F.trim("text") == "", 1)).alias("empty_texts"), F.count("text").alias("_have"))
    held = annotations.join(documents.select(doc, F.col("text").alias("_text")).dropDuplicates([doc]), doc, "left")
    bad = ~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("_text")) & (F.substr("_text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")), F.lit(False))
    w = W.partitionBy(doc).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("_over", F.coalesce(F.max("end").over(w) > F.col("start"), F.lit(False)))
    a = held.agg(F.count("*").alias("annotations"), F.count(F.when(F.col("_text").isNull(), 1)).alias("orphans"), F.count(F.when(F.col("_text").isNotNull() & bad, 1)).alias("bad_offsets"), F.count(F.when(F.col("_over"), 1)).alias("overlaps"))
    return d.join(F.broadcast(a)).select("documents", (F.col("documents") - F.col("_ids")).alias("repeated_ids"), (F.col("_have") - F.col("_texts")).alias("repeated_texts"), "empty_texts", "annotations", "orphans", "bad_offsets", "overlaps")


def learned_edits(observations: DataFrame, least: int = 3, precision: float = 0.9) -> DataFrame:
    """Rewrites of one word that hold often enough: (entity_type, source, target, support, correct, precision).

    ``observations``: mention and alias (normal forms), entity_type.  A rule comes from pairs that differ in one word; its
    support is every mention of the type with the source word, correct where the rewrite gives the alias.
    """
    key = F.monotonically_increasing_id()
    o = observations.select("entity_type", F.split("mention", " ").alias("m"), F.split("alias", " ").alias("a"), "mention", "alias", key.alias("_id"))
    differ = F.filter(F.arrays_zip("m", "a"), lambda z: ~z["m"].eqNullSafe(z["a"]))
    rules = o.where(F.size("m") == F.size("a")).withColumn("d", differ).where("size(d) = 1").select("entity_type", F.col("d")[0]["m"].alias("source"), F.col("d")[0]["a"].alias("target")).distinct()
    words = o.select("entity_type", "mention", "alias", "m", F.explode(F.array_distinct("m")).alias("source"))
    tried = words.join(rules, ["entity_type", "source"])
    made = F.array_join(F.transform("m", lambda x: F.when(x == F.col("source"), F.col("target")).otherwise(x)), " ")
    t = tried.groupBy("entity_type", "source", "target").agg(F.count("*").alias("support"), F.count(F.when(made == F.col("alias"), 1)).alias("correct"))
    return t.withColumn("precision", F.round(F.col("correct") / F.col("support"), 6)).where((F.col("support") >= least) & (F.col("precision") >= precision))


def fit_sparse_logistic(examples: DataFrame, rate: float = 0.5, decay: float = 0.0, l2: float = 0.001, epochs: int = 200, tolerance: float = 1e-6, most: int = 200_000) -> dict[str, float]:
    """Weights by name (the bias under ``""``) of a logistic model on (features map, label, weight), by full-batch steps.

    The model is fitted on the driver, on at most about ``most`` examples thinned by a hash of their features.
    """
    n = examples.count()
    every = max(1, -(-n // most))
    rows = examples.select(F.map_entries("features").alias("f"), "label", "weight").where(F.pmod(F.xxhash64("f", "label"), F.lit(every)) == 0).collect()
    labels = np.array([r["label"] for r in rows], float)
    if set(labels.tolist()) != {0.0, 1.0}:
        raise ValueError("both classes are needed")
    names = sorted({e["key"] for r in rows for e in r["f"]})
    at = {k: i for i, k in enumerate(names)}
    row = np.array([i for i, r in enumerate(rows) for _ in r["f"]])
    col = np.array([at[e["key"]] for r in rows for e in r["f"]])
    value = np.array([e["value"] for r in rows for e in r["f"]], float)
    weight = np.array([r["weight"] for r in rows], float)
    total, w = weight.sum(), np.zeros(len(names))
    share = min(max((labels * weight).sum() / total, 1e-6), 1 - 1e-6)
    bias = math.log(share / (1 - share))
    for epoch in range(epochs):
        z = bias + np.bincount(row, w[col] * value, len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels) * weight
        step = rate / math.sqrt(1 + decay * epoch)
        down = step * (np.bincount(col, error[row] * value, len(names)) / total + l2 * w)
        change = step * error.sum() / total
        bias -= change
        w -= down
        if max(abs(change), np.abs(down).max(initial=0.0)) < tolerance:
            break
    return {"": bias, **dict(zip(names, w.tolist(), strict=True))}


def alias_candidates(docs: DataFrame, standard: DataFrame, runtime: DataFrame, text: str = "text", most_words: int = 4) -> DataFrame:
    """(norm, concept_id, occurrences, documents): names of the standard that texts use and the runtime lacks.

    Texts become runs of 1 to ``most_words`` words, kept only if they are a wanted name, so the join is on equal keys.
    """
    wanted = standard.where("norm <> ''").select("norm", "concept_id").distinct().join(runtime.select("norm").distinct(), "norm", "left_anti")
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    w = docs.select(F.col(docs.columns[0]).alias("_doc"), words.alias("w"))
    each = None
    for n in range(1, most_words + 1):
        at = w.where(F.size("w") >= n).select("_doc", "w", F.explode(F.sequence(F.lit(1), F.size("w") - (n - 1))).alias("i"))
        part = at.select("_doc", F.array_join(F.slice("w", F.col("i"), n), " ").alias("norm"))
        each = part if each is None else each.unionByName(part)
    per = each.groupBy("norm", "_doc").agg(F.count("*").alias("n")).groupBy("norm").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))
    return per.join(wanted, "norm")


def quote_curriculum(documents: DataFrame, annotations: DataFrame, doc: str = "document_id") -> DataFrame:
    """Training rows that ask for exact quotes: (doc, instruction, answer, occurrence): a mention and which of its places it is.

    The occurrence counts the places of equal text before it in the document, so a repeated quote names one place.
    """
    held = annotations.join(documents.select(doc, F.col("text").alias("_text")), doc)
    good = F.substr("_text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    before = F.size(F.split(F.substr("_text", F.lit(1), F.col("start")), F.concat(F.lit(r"\Q"), F.col("text"), F.lit(r"\E")), -1)) - 1
    return held.where(good).select(doc, F.concat(F.lit("Quote the "), F.lower("entity_type")).alias("instruction"), F.col("text").alias("answer"), before.alias("occurrence"), "start", "end")


def pipeline_report(totals: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per counter: now, before, and the change, absolute and as a share; counters of one side only count 0 on the other."""
    held = totals.select("name", F.col("value").alias("now")).join(baseline.select("name", F.col("value").alias("before")), "name", "full").fillna(0, ["now", "before"])
    return held.withColumn("change", F.col("now") - F.col("before")).withColumn("share", F.round(F.when(F.col("before") != 0, F.col("change") / F.col("before")), 6))
