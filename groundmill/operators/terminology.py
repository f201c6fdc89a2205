"""Terminology and graph stores as tables: lookups by code and name in a fixed order, composites, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranks of a concept's term type, for ties only (fixed values); any other is 20.
TTY_RANK = {"IN": 0, "PIN": 1, "MIN": 2, "BN": 3, "SCD": 4, "SBD": 5, "SCDF": 6, "SBDF": 7, "GPCK": 8, "BPCK": 9}
#: Ranks of where an alias comes from (fixed values); any other is 2.
ALIAS_RANK = {
    "canonical_name": 0, "official_name_vi": 1, "official_name_en": 1, "alias": 2, "synonym": 2, "abbreviation": 2,
    "generic_name": 3, "brand_name": 3, "ingredient": 4,
}


def ranked(column: Column, ranks: dict[str, int], other: int) -> Column:
    """The rank of each value, by a literal map."""
    pairs = [F.lit(x) for kv in ranks.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(other))


def concept_filter(entity_type: str | None = None, code_systems: list[str] | None = None) -> Column:
    """The type and the systems asked for; an empty list of systems admits nothing."""
    out = F.lit(True) if entity_type is None else F.col("semantic_type") == entity_type
    return out if code_systems is None else out & (F.col("code_system").isin(code_systems) if code_systems else F.lit(False))


def by_code(concepts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (code_system, code) with the least concept id of each code, null for an unknown one."""
    least = concepts.where("code is not null").groupBy("code_system", "code").agg(F.min("concept_id").alias("concept_id"))
    return asked.join(least, ["code_system", "code"], "left")


def contains(concepts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with ``known``: whether the release has the code."""
    have = concepts.where("code is not null").select("code_system", "code").distinct().withColumn("known", F.lit(True))
    return asked.join(have, ["code_system", "code"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def ordered_lookup(mentions: DataFrame, aliases: DataFrame, concepts: DataFrame, key: str = "norm", limit: int = 20) -> DataFrame:
    """(key, concept_id, alias_rank, rank): the first ``limit`` concepts of each distinct key.

    Order: where the alias comes from, the term type, code system, code, id.  Keys are looked up once each, so frequent
    mentions cost nothing more; join the result back on the key.
    """
    asked = mentions.select(key).distinct()
    best = aliases.groupBy(key, "concept_id").agg(F.min(ranked(F.col("alias_source"), ALIAS_RANK, 2)).alias("alias_rank"))
    found = best.join(asked, key).join(concepts, "concept_id")
    order = W.partitionBy(key).orderBy("alias_rank", ranked(F.col("tty"), TTY_RANK, 20), "code_system", F.coalesce("code", F.lit("")), "concept_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(key, "concept_id", "alias_rank", "rank")


def composite(lookups: list[DataFrame], key: str = "norm", limit: int = 20) -> DataFrame:
    """Answers of several stores in their order: a concept counts where it comes first, at most ``limit`` a key."""
    all_ = None
    for n, part in enumerate(lookups):
        part = part.select(key, "concept_id", "rank", F.lit(n).alias("store"))
        all_ = part if all_ is None else all_.unionByName(part)
    first = all_.groupBy(key, "concept_id").agg(F.min(F.struct("store", "rank")).alias("at"))
    order = W.partitionBy(key).orderBy("at", "concept_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(key, "concept_id", F.col("at.store").alias("store"), "rank")


def composite_scored(hits: list[DataFrame], key: str = "norm", limit: int = 20) -> DataFrame:
    """Scored answers of several stores: a concept's best score, the earlier store at ties, at most ``limit`` a key."""
    all_ = None
    for n, part in enumerate(hits):
        part = part.select(key, "concept_id", "score", F.lit(n).alias("store"))
        all_ = part if all_ is None else all_.unionByName(part)
    best = all_.groupBy(key, "concept_id").agg(F.max(F.struct("score", (-F.col("store")).alias("minus"))).alias("top"))
    order = W.partitionBy(key).orderBy(F.desc("top.score"), F.desc("top.minus"), "concept_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
        key, "concept_id", F.col("top.score").alias("score"), (-F.col("top.minus")).alias("store"), "rank"
    )


def token_query(norm: Column) -> Column:
    """The distinct tokens of three letters or more that a fallback search asks for.

    Null where there are fewer than two, or a number of one or two digits: such a number tells subtypes apart.
    """
    tokens = F.filter(F.split(norm, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    short = F.exists(tokens, lambda t: t.rlike("^[0-9]{1,2}$"))
    long = F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= 3))
    return F.when(~short & (F.size(long) >= 2), long)


def fallback_search(mentions: DataFrame, aliases: DataFrame, key: str = "norm") -> DataFrame:
    """(key, concept_id, kind): concepts whose alias holds the whole key, all of its tokens or some of them.

    Aliases are indexed by their tokens (sets, so a token meets an alias once); a key meets the aliases of its rarest
    token only, for the whole key and for all tokens, and those of each for ``partial_tokens``.
    """
    asked = mentions.select(key, token_query(F.col(key)).alias("tokens")).distinct().where("tokens is not null")
    index = aliases.select("concept_id", F.col(key).alias("alias"), F.explode(F.array_distinct(F.split(key, r"[^\p{L}\p{N}]+"))).alias("token")).where("token <> ''")
    met = asked.select(key, "tokens", F.explode("tokens").alias("token")).join(index, "token")
    shared = met.groupBy(key, "tokens", "concept_id", "alias").agg(F.count("*").alias("n"))
    kind = F.when(F.col("alias").contains(F.col(key)), 0).when(F.col("n") == F.size("tokens"), 1).otherwise(2)
    return shared.groupBy(key, "concept_id").agg(F.min(kind).alias("k")).select(key, "concept_id", F.element_at(F.array(*map(F.lit, ("phrase", "all_tokens", "partial_tokens"))), F.col("k") + 1).alias("kind"))


def reviewed_matches(mentions: DataFrame, memory: DataFrame, concepts: DataFrame) -> DataFrame:
    """Mentions with a reviewed code that the release still has: a terminal answer of score 1.

    ``memory``: (norm, entity_type, code_system, code, review_status); only ``reviewed`` rows count, and a key with two
    different codes answers nothing.
    """
    key = ["norm", "entity_type"]
    one = memory.where("review_status = 'reviewed'").groupBy(*key).agg(F.collect_set(F.struct("code_system", "code")).alias("codes")).where("size(codes) = 1")
    coded = one.select(*key, F.col("codes")[0]["code_system"].alias("code_system"), F.col("codes")[0]["code"].alias("code"))
    return mentions.join(by_code(concepts, coded).where("concept_id is not null"), key).withColumn("score", F.lit(1.0))


def search_nodes(asked: DataFrame, nodes: DataFrame, aliases: DataFrame, limit: int = 20) -> DataFrame:
    """(norm, node_id, stage, rank): nodes of an equal name, then of an equal toneless name, the frequent ones first.

    Distinct keys are looked up once; names shorter than two characters have no second stage.
    """
    keys = asked.select("norm", "toneless").distinct()
    exact = keys.join(aliases.select("norm", "node_id"), "norm").select("norm", "node_id", F.lit(0).alias("stage"))
    loose = keys.where(F.length("norm") >= 2).join(aliases.select("toneless", "node_id"), "toneless").select("norm", "node_id", F.lit(1).alias("stage"))
    found = exact.unionByName(loose).groupBy("norm", "node_id").agg(F.min("stage").alias("stage")).join(nodes.select("node_id", "occurrence_count"), "node_id")
    order = W.partitionBy("norm").orderBy("stage", F.desc("occurrence_count"), "node_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("norm", "node_id", "stage", "rank")


def graph_concepts(asked: DataFrame, nodes: DataFrame, aliases: DataFrame, entity_type: str | None = None, limit: int = 20) -> DataFrame:
    """Coded nodes found by name, as candidates: 1.0 by an equal name, 0.92 by a toneless one."""
    usable = nodes.where("code is not null" + ("" if entity_type is None else f" and entity_type = '{entity_type}'"))
    found = search_nodes(asked, usable, aliases, limit).join(usable.select("node_id", "code_system", "code"), "node_id")
    return found.withColumn("score", F.when(F.col("stage") == 0, 1.0).otherwise(0.92))


def edge_evidence(edges: DataFrame, evidence: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` rows of evidence of each asked edge, by id."""
    order = W.partitionBy("edge_id").orderBy("evidence_id")
    return evidence.join(edges.select("edge_id").distinct(), "edge_id", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def write_index(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> str:
    """Tables sorted and ranged by their lookup key under one folder named by the digest of their rows.

    A folder that is complete (it has a ``_DONE`` table) is left alone: the same content is written once.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    parts = [df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first() for df, _ in tables.values()]
    digest = spark.range(1).select(F.sha2(F.lit("|".join(f"{n}:{c}:{s}" for n, (c, s) in zip(tables, parts, strict=True))), 256)).first()[0][:24]
    root = f"{path.rstrip('/')}/{digest}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_DONE")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        for name, (df, key) in tables.items():
            df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}")
        spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_DONE")
    return root
