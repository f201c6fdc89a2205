"""Metrics as aggregations: every one is a grouped sum, so it has a partial stage before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def with_prf(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from columns tp, fp and fn; empty denominators give 0."""
    df = df.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return df.withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def set_prf(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact set comparison of distinct keys (spans, relations, codes): tp, fp, fn and P/R/F1."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), pred.select(*keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, keys, "full_outer")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return with_prf(
        both.groupBy(*(by or [])).agg(
            count(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), count(F.col("g").isNull()).alias("fp"), count(F.col("p").isNull()).alias("fn")
        )
    )


def recall_at_k(ranked: DataFrame, ks: list[int], hit: str = "hit_rank") -> DataFrame:
    """One row: queries, recall at each k and mean reciprocal rank, from the rank of the first hit (null: none)."""
    r = F.col(hit)
    return ranked.agg(
        F.count("*").alias("queries"), *[F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks],
        F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"),
    )


def coverage_curve(scored: DataFrame, thresholds: tuple[float, ...] = (0, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95)) -> DataFrame:
    """Coverage and accuracy of rows (score, correct) kept at each threshold, in one pass over the rows."""
    at = scored.select("score", "correct", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    kept = F.col("score") >= F.col("threshold")
    return at.groupBy("threshold").agg(
        F.avg(kept.cast("int")).alias("coverage"), F.coalesce(F.avg(F.when(kept, F.col("correct").cast("int"))), F.lit(0.0)).alias("accuracy")
    )


def confusion(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Counts of each gold and predicted label."""
    return pairs.groupBy(gold, pred).count()


def macro_f1(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Macro F1 over the labels that gold has: one row."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), (F.col(gold) == F.col(pred)).cast("int").alias("t")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(0).alias("t")))).alias("s")).select("s.*")
    per = sides.groupBy("label").agg(F.sum("t").alias("tp"), F.sum("g").alias("support"), F.sum(1 - F.col("g")).alias("predicted"))
    per = per.where("support > 0").withColumn("f1", 2 * F.col("tp") / (F.col("support") + F.col("predicted")))
    return per.agg(F.count("*").alias("labels"), F.avg("f1").alias("macro_f1"))


def binary_metrics(rows: DataFrame, p: str = "p", y: str = "y", threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """One row: tp/fp/fn/tn, P/R/F1, log loss, Brier score and calibration error over equal bins."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    yes, said = F.col(y) == 1, F.col(p) >= threshold
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).alias("bin")).agg(
        n(yes & said).alias("tp"), n(~yes & said).alias("fp"), n(yes & ~said).alias("fn"), n(~yes & ~said).alias("tn"),
        F.sum(F.when(yes, -F.log(q)).otherwise(-F.log(1 - q))).alias("loss"), F.sum((F.col(p) - F.col(y)) ** 2).alias("squares"),
        F.count("*").alias("n"), F.sum(p).alias("ps"), F.sum(y).alias("ys"),
    )
    total = per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "loss", "squares", "n")], F.sum(F.abs(F.col("ps") - F.col("ys"))).alias("gap"))
    return with_prf(total).select("tp", "fp", "fn", "tn", "precision", "recall", "f1", (F.col("loss") / F.col("n")).alias("log_loss"), (F.col("squares") / F.col("n")).alias("brier"), (F.col("gap") / F.col("n")).alias("ece"))


def index_percentiles(rows: DataFrame, value: str, by: list[str], qs: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """Median, and the element at index floor(n q) of the ordered values (no interpolation), for each group.

    Groups are few by nature (stages, profiles): equal values are counted first, so a group's window sorts its distinct
    values in one task.
    """
    w = W.partitionBy(*by)
    held = rows.groupBy(*by, value).agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(w))
    ranked = held.withColumn("to", F.sum("c").over(w.orderBy(value))).withColumn("from", F.col("to") - F.col("c"))
    is_at = lambda i: (F.col("from") <= i) & (i < F.col("to"))
    at = lambda q: F.max(F.when(is_at(F.least(F.col("n") - 1, F.floor(F.col("n") * q))), F.col(value)))
    mid = (F.max(F.when(is_at(F.floor((F.col("n") - 1) / 2)), F.col(value))) + F.max(F.when(is_at(F.floor(F.col("n") / 2)), F.col(value)))) / 2
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), mid.alias("p50"), *[at(q).alias(f"p{round(q * 100)}") for q in qs])


def stage_totals(trace: DataFrame, stage: str, ms: str, order: str) -> DataFrame:
    """Calls, total, mean and largest time of each stage, numbered as first seen."""
    per = trace.groupBy(stage).agg(F.count("*").alias("calls"), F.sum(ms).alias("total_ms"), F.avg(ms).alias("avg_ms"), F.max(ms).alias("max_ms"), F.min(order).alias("first"))
    return per.withColumn("position", F.row_number().over(W.orderBy("first", stage))).drop("first")


def bottlenecks(trace: DataFrame, doc: str, stage: str, ms: str) -> DataFrame:
    """In how many documents each stage took longest (the later name at ties)."""
    return trace.groupBy(doc).agg(F.max_by(stage, F.struct(ms, stage)).alias(stage)).groupBy(stage).agg(F.count("*").alias("documents"))


def relation_slices(relations: DataFrame, slices: list[str]) -> DataFrame:
    """Counts by each slice column alone, by grouping sets in one pass."""
    relations = relations.select(*[F.col(c).cast("string").alias(c) for c in slices])
    made = F.explode(F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).alias("value")) for c in slices]))
    return relations.select(made.alias("s")).groupBy("s.slice", "s.value").count()


def distance_bucket(distance: Column) -> Column:
    """0-40, 41-160 or 161+."""
    return F.when(distance <= 40, "0-40").when(distance <= 160, "41-160").otherwise("161+")


def pairwise_agreement(items: DataFrame, unit: str, rater: str, item: str) -> DataFrame:
    """Mean pairwise Jaccard of the raters' item sets in each unit (two empty sets agree), then over units.

    Sets stay exploded: intersections are counted by a join on the item, so no unit's items are collected.
    """
    own = items.select(unit, rater, item).where(F.col(item).isNotNull()).distinct()
    raters = items.select(unit, rater).distinct().join(own.groupBy(unit, rater).agg(F.count("*").alias("n")), [unit, rater], "left").fillna(0, ["n"])
    a = raters.select(unit, F.col(rater).alias("a"), F.col("n").alias("na"))
    b = raters.select(unit, F.col(rater).alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, unit).where("a < b")
    common = own.select(unit, F.col(rater).alias("a"), item).join(own.select(unit, F.col(rater).alias("b"), item), [unit, item]).where("a < b").groupBy(unit, "a", "b").agg(F.count("*").alias("common"))
    j = pairs.join(common, [unit, "a", "b"], "left").fillna(0, ["common"])
    union = F.col("na") + F.col("nb") - F.col("common")
    j = j.withColumn("jaccard", F.when(union == 0, 1.0).otherwise(F.col("common") / union))
    return j.groupBy(unit).agg(F.count("*").alias("pairs"), F.avg("jaccard").alias("agreement"))


def agreement_gate(report: DataFrame, minima: dict[str, float]) -> DataFrame:
    """``report`` with the failed thresholds as an array."""
    return report.withColumn("failed", F.array_compact(F.array(*[F.when(F.coalesce(F.col(k), F.lit(0.0)) < v, F.lit(k)) for k, v in minima.items()])))


def typed_errors(gold: DataFrame, pred: DataFrame, doc: str = "document_id") -> DataFrame:
    """Gold entities (doc, start, end, type, code, assertion) with the first kind of error, correct ones left out."""
    p = pred.select(doc, "start", "end", F.col("type").alias("ptype"), F.col("code").alias("pcode"), F.col("assertion").alias("passert"), F.lit(True).alias("found"))
    docs = pred.select(doc).distinct().withColumn("seen", F.lit(True))
    j = gold.join(p, [doc, "start", "end"], "left").join(docs, doc, "left")
    kind = (
        F.when(F.col("seen").isNull(), "missing_document").when(F.col("found").isNull(), "missing_entity").when(F.col("type") != F.col("ptype"), "type_error")
        .when(~F.col("code").eqNullSafe(F.col("pcode")), "linking_error").when(~F.col("assertion").eqNullSafe(F.col("passert")), "context_error")
    )
    return j.withColumn("error", kind).where("error is not null").select(doc, "start", "end", "type", "error")
