"""Crosswalks from mined surfaces to concepts: exact matches as review evidence, links, harmonised labels, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.operators.mining import content_id


def crosswalk(entries: DataFrame, concepts: DataFrame, aliases: DataFrame, policies: DataFrame, limit: int = 1000, keep: int = 20) -> DataFrame:
    """``entries`` with (policy_id, status, concepts, candidates): how far each surface determines a code.

    ``entries``: term_id, entity_type, source_label, norm.  ``policies``: policy_id, source_entity_type, source_label
    (null: any other label), target_types, code_systems (arrays); a short table.  A surface whose matches for one target
    type reach ``limit`` is ``ambiguous_truncated``; ``candidates`` lists the first ``keep`` concept ids.  Terms of one surface and policy
    are met once together, so the work grows with the surfaces and concepts, not with terms by concepts; a term with several
    rows is counted over all of them.
    """
    p = F.broadcast(policies.select("policy_id", F.col("source_entity_type").alias("entity_type"), F.col("source_label").alias("_label"), "target_types", "code_systems"))
    own = entries.join(p.where("_label is not null"), (entries["entity_type"] == p["entity_type"]) & (entries["source_label"] == F.col("_label"))).drop(p["entity_type"])
    rest = entries.join(own.select("term_id"), "term_id", "left_anti")
    rest = rest.join(p.where("_label is null"), "entity_type", "left").select(own.columns)
    asked = own.unionByName(rest).withColumn("_n", F.count("*").over(W.partitionBy("term_id")))
    by_norm = F.concat_ws("\0", F.lit("norm"), "norm", "policy_id", F.to_json(F.struct("target_types", "code_systems")))
    key = F.when(F.col("_n") == 1, by_norm).otherwise(F.concat_ws("\0", F.lit("term"), "term_id"))
    asked = asked.withColumn("_key", F.when(F.col("term_id").isNotNull() & F.col("policy_id").isNotNull() & F.col("norm").isNotNull(), key))
    sought = asked.where("_key is not null").select("_key", "_n", "norm", "target_types", "code_systems")
    sought = sought.where("_n = 1").distinct().unionByName(sought.where("_n > 1")).drop("_n")
    names = aliases.select("norm", "concept_id").distinct().join(concepts.select("concept_id", "code_system", "code", "semantic_type"), "concept_id")
    met = sought.join(names, "norm").where("array_contains(target_types, semantic_type) and array_contains(code_systems, code_system)")
    cells = met.groupBy("_key", "semantic_type", "code_system", "code").agg(F.count("*").alias("n"))
    per_type = cells.groupBy("_key", "semantic_type").agg(F.sum("n").alias("n")).groupBy("_key").agg(F.max("n").alias("most"))
    code = F.when(F.col("code").isNotNull(), F.struct("code_system", "code"))
    tally = cells.groupBy("_key").agg(F.sum("n").alias("concepts"), F.count_distinct(code).alias("codes"), F.sum(F.when(F.col("code").isNull(), F.col("n")).otherwise(0)).alias("uncoded"))
    order = W.partitionBy("_key").orderBy("code_system", F.coalesce("code", F.lit("")), "concept_id")
    first = met.select("_key", "code_system", "code", "concept_id").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)
    first = first.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_r", "concept_id"))).alias("_c"))
    tally = tally.join(per_type, "_key").join(first, "_key", "left")
    status = (
        F.when(F.col("policy_id").isNull(), "skipped_no_policy").when(F.col("most") >= limit, "ambiguous_truncated").when(F.col("concepts").isNull(), "unmatched")
        .when(F.col("codes") == 0, "concept_only_exact").when(F.col("concepts") == 1, "unique_concept_exact")
        .when((F.col("codes") == 1) & (F.col("uncoded") == 0), "unique_code_exact").otherwise("ambiguous_code_exact")
    )
    return asked.join(tally, "_key", "left").withColumn("status", status).select(
        *entries.columns, "policy_id", "status", F.coalesce("concepts", F.lit(0)).alias("concepts"), F.transform("_c", lambda x: x["concept_id"]).alias("candidates")
    )


def attach_links(annotations: DataFrame, links: DataFrame, append: bool = False) -> DataFrame:
    """``annotations`` with ``decision`` and, where it says so, one more concept.

    ``links``: (entity_type, source_label, norm, code_system, code), one row per key.  Existing links are kept and a
    conflicting one is never written over; ids, offsets and texts stay.
    """
    new = links.select("entity_type", F.col("source_label").alias("_label"), "norm", F.col("code_system").alias("_system"), F.col("code").alias("_code"))
    held = annotations.join(new, (annotations["entity_type"] == new["entity_type"]) & annotations["source_label"].eqNullSafe(F.col("_label")) & (annotations["norm"] == new["norm"]), "left").drop(new["entity_type"], new["norm"])
    same = F.exists("concepts", lambda c: (c["code_system"] == F.col("_system")) & (c["code"] == F.col("_code")))
    system = F.exists("concepts", lambda c: c["code_system"] == F.col("_system"))
    some = F.size("concepts") > 0
    decision = (
        F.when(F.col("_code").isNull(), "no_eligible_crosswalk").when(same, "already_linked").when(system, "existing_code_system_conflict")
        .when(some & F.lit(not append), "existing_concept_conflict").when(some, "linked_additional_code_system").otherwise("linked")
    )
    held = held.withColumn("decision", decision)
    more = F.concat("concepts", F.array(F.struct(F.col("_system").alias("code_system"), F.col("_code").alias("code"))))
    return held.withColumn("concepts", F.when(F.col("decision").startswith("linked"), more).otherwise(F.col("concepts"))).select(*annotations.columns, "decision")


def harmonize(annotations: DataFrame, rules: DataFrame, concepts: DataFrame, preserve: bool = False) -> DataFrame:
    """``annotations`` with the target type of their rule and their codes mapped to its systems.

    ``rules``: rule_id, source_id, entity_type, source_label, target_type, systems (map from source to target system); a
    short table.  A code that the target release has not, or has under another type, is dropped into ``unmapped`` (and
    kept with ``preserve``).  Offsets and ids are not touched; rows without a rule stay as they are.
    """
    r = F.broadcast(rules)
    key = ["source_id", "entity_type", "source_label"]
    held = annotations.withColumn("source_label", F.coalesce("source_label", F.lit(""))).join(r, key, "left")
    each = held.where("rule_id is not null").select("annotation_id", "target_type", "systems", F.posexplode("concepts").alias("pos", "c"))
    each = each.withColumn("to", F.element_at("systems", F.col("c.code_system")))
    least = concepts.where("code is not null").groupBy(F.col("code_system").alias("to"), F.col("code").alias("_code")).agg(F.min_by("semantic_type", "concept_id").alias("_type"))
    met = each.join(least, (each["to"] == least["to"]) & (F.col("c.code") == F.col("_code")), "left").drop(least["to"])
    ok = F.col("_type") == F.col("target_type")
    reason = F.when(F.col("to").isNull() | F.coalesce(ok, F.lit(False)), F.lit(None)).when(F.col("_type").isNull(), "unknown_target_code").otherwise("target_semantic_type_mismatch")
    met = met.withColumn("reason", reason)
    kept = F.when(F.col("to").isNull(), F.col("c")).when(F.col("reason").isNull(), F.struct(F.col("to").alias("code_system"), F.col("c.code").alias("code"))).when(F.lit(preserve), F.col("c"))
    lists = met.select("annotation_id", "pos", kept.alias("k"), F.when(F.col("reason").isNotNull(), F.struct("c.code_system", "c.code", "reason")).alias("u"))
    of = lambda x: F.transform(F.array_sort(F.collect_list(F.when(F.col(x).isNotNull(), F.struct("pos", x)))), lambda s: s[x])
    mapped = lists.groupBy("annotation_id").agg(of("k").alias("_mapped"), of("u").alias("_unmapped"))
    out = held.join(mapped, "annotation_id", "left")
    ruled = F.col("rule_id").isNotNull()
    none = F.array().cast(lists.select(F.array("u")).schema[0].dataType)
    return out.withColumns({
        "concepts": F.when(ruled, F.coalesce("_mapped", F.col("concepts"))).otherwise(F.col("concepts")),
        "entity_type": F.when(ruled, F.col("target_type")).otherwise(F.col("entity_type")),
        "unmapped": F.coalesce("_unmapped", none),
    }).select(*annotations.columns, "rule_id", "unmapped")


def link_products(products: DataFrame, by_label: DataFrame, by_code: DataFrame) -> DataFrame:
    """(document_id, status, selected): a product's concept where two sources agree on exactly one.

    ``products``: document_id, set_id, spl_version, ndc_prefix, valid; ``by_label``: set_id, spl_version, rxcui;
    ``by_code``: ndc_prefix, rxcui.  Candidates of both sources are counted and met by joins.
    """
    label = products.join(by_label.select("set_id", "spl_version", "rxcui").distinct(), ["set_id", "spl_version"]).select("document_id", "rxcui")
    code = products.join(by_code.select("ndc_prefix", "rxcui").distinct(), "ndc_prefix").select("document_id", "rxcui")
    both = label.withColumn("l", F.lit(1)).withColumn("c", F.lit(0)).unionByName(code.withColumn("l", F.lit(0)).withColumn("c", F.lit(1)))
    each = both.groupBy("document_id", "rxcui").agg(F.max("l").alias("l"), F.max("c").alias("c"))
    tally = each.groupBy("document_id").agg(
        F.sum("l").alias("labels"), F.sum("c").alias("codes"), F.sum(F.col("l") * F.col("c")).alias("common"), F.min(F.when(F.col("l") + F.col("c") == 2, F.col("rxcui"))).alias("one")
    )
    status = (
        F.when(~F.col("valid"), "invalid_product_record").when(F.col("common") == 1, "exact_unique_intersection").when(F.col("common") > 1, "ambiguous_intersection")
        .when((F.col("labels") > 0) & (F.col("codes") > 0), "source_disagreement").when(F.col("labels") > 0, "spl_only").when(F.col("codes") > 0, "ndc_only").otherwise("unmapped")
    )
    found = products.join(tally, "document_id", "left").withColumn("status", status)
    return found.select("document_id", "status", F.when(F.col("common") == 1, F.col("one")).alias("selected"))


def mapping_counts(mapping: DataFrame, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: how many codes and (code, name) pairs of ``mapping`` (code, norm) the release knows."""
    codes, pairs = mapping.select("code").distinct(), mapping.select("code", "norm").distinct()
    known = concepts.where("code is not null").select("code").distinct().withColumn("k", F.lit(1))
    named = aliases.join(concepts.where("code is not null").select("concept_id", "code"), "concept_id").select("code", "norm").distinct().withColumn("n", F.lit(1))
    a = codes.join(known, "code", "left").agg(F.count("*").alias("codes"), F.count("k").alias("known_codes"))
    b = pairs.join(known, "code", "left").join(named, ["code", "norm"], "left").agg(
        F.count("*").alias("pairs"), F.count("n").alias("existing_pairs"), F.count(F.when(F.col("k").isNotNull() & F.col("n").isNull(), 1)).alias("proposals")
    )
    return a.join(F.broadcast(b)).withColumn("unknown_codes", F.col("codes") - F.col("known_codes"))


def alias_proposals(mapping: DataFrame, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names of known codes that the release lacks, with support (most rows behind one surface) and surfaces."""
    named = aliases.join(concepts.where("code is not null").select("concept_id", "code"), "concept_id").select("code", "norm").distinct()
    known = concepts.where("code is not null").select("code").distinct()
    new = mapping.join(known, "code", "left_semi").join(named, ["code", "norm"], "left_anti")
    per = new.groupBy("code", "norm", "surface").agg(F.count_distinct("record").alias("support"))
    return per.groupBy("code", "norm").agg(F.max("support").alias("support"), F.array_sort(F.collect_set("surface")).alias("surfaces")).withColumn("proposal_id", content_id("alias", F.col("code"), F.col("norm")))
