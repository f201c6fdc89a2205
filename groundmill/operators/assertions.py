"""Assertion of a mention by rules: cues in its clause, negation over commas, sections, and the graph behind a decision.

A mention's left and right context are the parts of its sentence up to the next clause boundary.  A cue holds if it
stands in a context as a whole word, lies in no false-positive phrase, is near enough, and no terminating cue stands in
between.  Everything is a join with the short cue table and expressions on the contexts; nothing is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.functions.text import tiles

# Boundaries, phrases and words that decide the scope of a cue.
BOUNDARY = r"[\n.;:!?]|,\s+"
COORDINATION_BOUNDARY = r"[\n.;!?]"
RESET = (
    r"chuyển\s+sang\s+(?:sử\s+dụng|điều\s+trị\s+bằng)", r"bắt\s+đầu\s+dùng", r"chẩn\s+đoán", r"được\s+kê", r"được\s+chỉ\s+định",
)
NEGATION_PHRASES = (
    r"không\s+đặc\s+hiệu", r"không\s+loại\s+trừ", r"không\s+thuốc\s+cản\s+quang", r"không\s+thể\s+giữ\s+được", r"không\s+nghĩ.{0,100}có\s+khả\s+năng",
)
FAMILY_PHRASES = (r"con\s+trai\s+phát\s+hiện\s+bệnh\s+nhân", r"con\s+gái\s+phát\s+hiện\s+bệnh\s+nhân")
COORDINATION_BREAKS = (
    "nhưng", r"tuy\s+nhiên", "song", "however", "but", r"bệnh\s+nhân\s+có", r"bn\s+có", r"ghi\s+nhận\s+có", r"kèm\s+theo", "có", r"bệnh\s+nhân\s+bị",
    r"hậu\s+phẫu", r"chuyển\s+sang\s+(?:sử\s+dụng|điều\s+trị\s+bằng)", r"bắt\s+đầu\s+dùng", r"chẩn\s+đoán", r"có\s+khả\s+năng", r"được\s+kê",
    r"được\s+chỉ\s+định", r"tiền\s+sử", r"history\s+of",
)
FAMILY_MEMBERS = ("anh", "bà", "bố", "brother", "cha", "chị", "em", "father", "mẹ", "mother", "ông", "parent", "sister")
FAMILY_PREDICATES = ("bị", "mắc", "có", r"tiền\s+sử", r"history\s+of", r"diagnosed\s+with")
#: Statuses in order of precedence; PRESENT where none holds (fixed values).
PRECEDENCE = ("FAMILY", "NEGATED", "HISTORICAL", "PLANNED", "RESOLVED", "CONDITIONAL", "POSSIBLE")
#: Statuses that are read from both sides of a mention, besides family and negation.
DIRECTIONAL = ("HISTORICAL", "PLANNED", "RESOLVED", "POSSIBLE")


def words(patterns: tuple[str, ...]) -> str:
    """Any of ``patterns`` between word boundaries."""
    return r"(?iU)(?<!\w)(?:" + "|".join(patterns) + r")(?!\w)"


def left_context(text: Column, boundary: str = BOUNDARY) -> Column:
    """What follows the last boundary."""
    return F.regexp_extract(text, rf"(?s)^(?:.*(?:{boundary}))?(.*)$", 1)


def right_context(text: Column) -> Column:
    """What comes before the first boundary."""
    return F.regexp_extract(text, rf"(?s)^(.*?)(?:{BOUNDARY}|\z)", 1)


def _whole(cue: Column) -> Column:
    return F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.trim(cue), F.lit(r"\E(?!\w)"))


def _inside(context: Column, patterns: tuple[str, ...], at: Column, end: Column) -> Column:
    held = F.concat(*[tiles(context, words((p,))) for p in patterns])
    return F.exists(held, lambda m: (m["start"] <= at) & (end <= m["end"]))


def cue_matches(contexts: DataFrame, cues: DataFrame) -> DataFrame:
    """All cues that hold: ``contexts`` (id, side, context, entity_type, ...) with the cue's columns, cue_start, cue_end, gap.

    ``cues``: rule_id, cue, assertion, scope (left, right, bidirectional), priority, most, termination and types (arrays,
    null: none, any).  The table is a short list of rules and broadcast.
    """
    rules = F.broadcast(cues.where("scope <> 'section_prior'"))
    fits = ((F.col("scope") == F.col("side")) | (F.col("scope") == "bidirectional")) & F.contains(F.col("context"), F.lower(F.trim("cue")))
    any_type = F.col("types").isNull() | F.array_contains("types", F.col("entity_type"))
    c = contexts.join(rules, fits & any_type)
    c = c.withColumn("m", F.explode(tiles(F.col("context"), _whole(F.col("cue"))))).withColumn("cue_start", F.col("m.start")).withColumn("cue_end", F.col("m.end")).drop("m")
    left = F.col("side") == "left"
    c = c.withColumn("gap", F.when(left, F.length("context") - F.col("cue_end")).otherwise(F.col("cue_start")))
    between = F.when(left, F.substr("context", F.col("cue_end") + 1)).otherwise(F.substr("context", F.lit(1), F.col("cue_start")))
    ended = F.coalesce(F.exists("termination", lambda t: F.rlike(between, _whole(t))), F.lit(False))
    return c.where((F.col("gap") <= F.col("most")) & ~ended)


def classify(mentions: DataFrame, cues: DataFrame) -> DataFrame:
    """``mentions`` with (assertion, statuses, rules): the status by precedence, all that hold, and the rules behind them.

    ``mentions``: id, entity_type, sentence, start and end in it, section (or null).
    """
    text = F.lower("sentence")
    before, after = F.substr(text, F.lit(1), F.col("start")), F.substr(text, F.col("end") + 1)
    base = mentions.select("id", "entity_type", left_context(before).alias("l0"), right_context(after).alias("r"), left_context(before, COORDINATION_BOUNDARY).alias("segment"), "section")
    base = base.withColumn("l", F.regexp_extract("l0", rf"(?isU)^(?:.*(?<!\w)(?:{'|'.join(RESET)})(?!\w))?(.*)$", 1))
    part = lambda side, col, coordinated: base.select("id", "entity_type", F.lit(side).alias("side"), F.col(col).alias("context"), F.col("r").alias("other"), F.lit(coordinated).alias("coordinated"))
    contexts = part("left", "l", False).unionByName(part("right", "r", False))
    found = cue_matches(contexts, cues)
    at, end, context = F.col("cue_start"), F.col("cue_end"), F.col("context")
    rest = F.substr("context", end + 1)
    left = F.col("side") == "left"
    is_ = lambda *names: F.col("assertion").isin(*names)
    member = F.lower(F.trim("cue")).isin(*FAMILY_MEMBERS)
    predicate = F.concat(rest, F.lit(" "), F.col("other")).rlike(words(FAMILY_PREDICATES))
    family = is_("FAMILY") & (~left | (~_inside(context, FAMILY_PHRASES, at, end) & (~member | predicate)))
    negated = is_("NEGATED") & (~left | ~_inside(context, NEGATION_PHRASES, at, end))
    held = found.where(family | negated | is_(*DIRECTIONAL))
    wide = cue_matches(part("left", "segment", True), cues.where("assertion = 'NEGATED'"))
    wide = wide.where(~_inside(context, NEGATION_PHRASES, at, end) & ~rest.rlike(words(COORDINATION_BREAKS)))
    order = W.partitionBy("id", "assertion", "side", "coordinated").orderBy(F.desc("priority"), "gap", F.desc(F.length("cue")), "rule_id")
    best = held.unionByName(wide).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("id", "assertion", "rule_id")
    prior = F.broadcast(cues.where("scope = 'section_prior'").select("rule_id", "assertion", "types", "priority", F.lower(F.trim("cue")).alias("section")))
    titled = base.where("section is not null").withColumn("section", F.lower(F.trim("section"))).join(prior, "section").where("types is null or array_contains(types, entity_type)")
    titled = titled.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("priority"), "rule_id"))).where("_r = 1").select("id", "assertion", "rule_id")
    per = best.unionByName(titled).groupBy("id").agg(F.array_sort(F.collect_set("assertion")).alias("statuses"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    primary = reduce(lambda rest, s: F.when(F.array_contains("statuses", s), s).otherwise(rest), reversed(PRECEDENCE), F.lit("PRESENT"))
    out = mentions.join(per, "id", "left").withColumn("assertion", F.when(F.col("statuses").isNull(), "PRESENT").otherwise(primary))
    none = F.array().cast("array<string>")
    return out.withColumns({"statuses": F.coalesce("statuses", none), "rules": F.coalesce("rules", none)})


def context_graph(mentions: DataFrame, classified: DataFrame, cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) behind decisions: mentions and modifiers, and an edge from each rule that holds to its mention."""
    hold = classified.select("id", F.explode("rules").alias("rule_id")).join(F.broadcast(cues.select("rule_id", "cue", "assertion")), "rule_id")
    nodes = mentions.select(F.concat(F.lit("mention:"), "id").alias("node_id"), F.lit("mention").alias("kind"), F.col("entity_type").alias("label"))
    nodes = nodes.unionByName(hold.select(F.concat(F.lit("modifier:"), "rule_id").alias("node_id"), F.lit("modifier").alias("kind"), F.col("cue").alias("label")).distinct())
    edges = hold.select(F.concat(F.lit("modifier:"), "rule_id").alias("head"), F.concat(F.lit("mention:"), "id").alias("tail"), F.col("assertion").alias("relation"))
    return nodes, edges


def features(mentions: DataFrame, classified: DataFrame) -> DataFrame:
    """(id, features): a sparse map per mention: its type, section, statuses, rules and the words beside it."""
    near = lambda c, pattern: F.lower(F.regexp_extract(c, pattern, 1))
    held = mentions.join(classified.select("id", "statuses", "rules"), "id")
    before = near(F.substr("sentence", F.lit(1), F.col("start")), r"(?U)(\w+)\W*$")
    after = near(F.substr("sentence", F.col("end") + 1), r"(?U)^\W*(\w+)")
    one = lambda name, value: F.array(F.concat(F.lit(name + "="), F.coalesce(value, F.lit(""))))
    names = F.concat(
        one("type", F.col("entity_type")), one("section", F.lower("section")), one("before", before), one("after", after),
        F.transform("statuses", lambda s: F.concat(F.lit("status="), s)), F.transform("rules", lambda s: F.concat(F.lit("rule="), s)),
    )
    return held.select("id", F.map_from_entries(F.transform(F.array_distinct(F.filter(names, lambda n: ~n.endswith("="))), lambda n: F.struct(n.alias("key"), F.lit(1.0).alias("value")))).alias("features"))
