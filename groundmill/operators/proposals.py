"""Span proposals: from patterns, around anchors, grown, listed and paired; merged, resolved and explained."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.functions.text import tiles
from groundmill.operators.extract import per_island, proposal_utility, resolve_weighted
from groundmill.operators.segment import lines

# Patterns of laboratory values and of what is said about a drug.
LAB_PATTERNS = {
    "hba1c": r"(?i)(?<!\w)HbA1c\s*\d+(?:\.\d+)?%(?!\w)",
    "blood_pressure": r"(?i)(?<=(?<!\w)BP\s{0,4})\d{2,3}/\d{2,3}(?!\w)",
    "unit_value": r"(?i)(?<!\w)\d+(?:[\.,]\d+)?\s?(?:mmol/L|mg/dL|g/dL|ng/mL|mEq/L|IU/L|U/L|%)(?!\w)",
}
ATTRIBUTE_PATTERNS = {
    "STRENGTH": r"(?iU)(?<!\w)\d+(?:[.,]\d+)?\s*(?:mg|mcg|g|ml|iu|units?)(?:\s*/\s*(?:ml|l|kg))?(?!\w)",
    "DOSAGE": r"(?iU)(?<!\w)\d+(?:[.,]\d+)?\s*(?:viên|tablets?|capsules?|puffs?|nhát)(?!\w)",
    "ROUTE": r"(?iU)(?<!\w)(?:tiêm\s+tĩnh\s+mạch|truyền\s+tĩnh\s+mạch|đường\s+uống|intravenous|subcutaneous|sublingual|oral|iv|im|sc|sl|po|uống|tiêm)(?!\w)",
    "FREQUENCY": r"(?iU)(?<!\w)(?:q\d+h|bid|tid|qid|qd|daily|hằng\s+ngày|mỗi\s+\d+\s*giờ|\d+\s*lần\s*/\s*ngày)(?!\w)",
    "DURATION": r"(?iU)(?<!\w)(?:trong\s+)?\d+\s*(?:ngày|tuần|tháng|days?|weeks?|months?)(?!\w)",
    "DOSAGE_FORM": r"(?iU)(?<!\w)(?:viên\s+nang|viên\s+nén|dung\s+dịch|khí\s+dung|capsule|tablet|injection|solution|inhaler|nebulizer)(?!\w)",
}
LEFT_RIGHT = (48, 96)
ITEM = r"(?m)^[ \t]*(?:\d+[.)]|[-*•]|\(\d+\))[ \t]+"
INDICATION = r"(?i)\s+(?:for|điều trị|để)\s+|\s*\(cho\s+"


def pattern_spans(docs: DataFrame, rules: dict[str, str], doc: str, text: str) -> DataFrame:
    """(doc, rule_id, start, end, value): all matches of each rule; spans of several rules may overlap."""
    def of(rule: str, pattern: str) -> Column:
        return F.transform(tiles(F.col(text), pattern), lambda m: F.struct(F.lit(rule).alias("rule_id"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    per = F.concat(*[of(r, p) for r, p in rules.items()])
    return docs.select(doc, F.explode(per).alias("m")).select(doc, "m.*")


def _window(text: Column, start: Column, end: Column, left: int, right: int, boundary: str) -> tuple[Column, Column]:
    """Begin and end of the window around a span, cut at the nearest boundary sign on either side."""
    lo = F.greatest(start - left, F.lit(0))
    before, after = F.substr(text, lo + 1, start - lo), F.substr(text, end + 1, F.lit(right))
    begin = start - F.length(F.regexp_extract(before, rf"([^{boundary}]*)$", 1))
    return begin, end + F.length(F.regexp_extract(after, rf"^([^{boundary}]*)", 1))


def around(docs: DataFrame, anchors: DataFrame, rules: dict[str, str], doc: str, text: str, reach: tuple[int, int] = LEFT_RIGHT, boundary: str = r"\n\r.;") -> DataFrame:
    """(doc, rule_id, start, end, value, anchor_start): matches in the clause window of each anchor (start, end).

    A span found from several anchors counts once, for the nearest one; of overlapping spans of one anchor's rules the
    earlier rule's holds.
    """
    held = docs.select(doc, text).join(anchors.select(doc, F.col("start").alias("anchor_start"), F.col("end").alias("anchor_end")).distinct(), doc)
    lo, hi = _window(F.col(text), F.col("anchor_start"), F.col("anchor_end"), *reach, boundary)
    held = held.select(doc, "anchor_start", "anchor_end", lo.alias("lo"), F.substr(text, lo + 1, hi - lo).alias("w"))
    spans = pattern_spans(held.withColumn("_k", F.struct(doc, "anchor_start", "anchor_end", "lo")), rules, "_k", "w")
    spans = spans.select("_k.*", "rule_id", (F.col("start") + F.col("_k.lo")).alias("start"), (F.col("end") + F.col("_k.lo")).alias("end"), "value").drop("lo")
    gap = F.least(F.abs(F.col("start") - F.col("anchor_end")), F.abs(F.col("anchor_start") - F.col("end")))
    near = spans.withColumn("nth", F.row_number().over(W.partitionBy(doc, "rule_id", "start", "end").orderBy(gap, "anchor_start"))).where("nth = 1")
    rank = F.array_position(F.array(*map(F.lit, rules)), F.col("rule_id"))
    return first_free(near.withColumn("order", rank), doc, "order").drop("nth", "order", "anchor_end")


def first_free(spans: DataFrame, doc: str, rank: str) -> DataFrame:
    """Spans kept in order of ``rank``, then place, if they overlap none kept before: within each overlap island."""
    def chosen(rows: list) -> list[int]:
        kept, out = [], []
        for r in sorted(rows, key=lambda r: (getattr(r, rank), r.start, r.end)):
            if all(r.end <= s or e <= r.start for s, e in kept):
                kept.append((r.start, r.end))
                out.append(r.Index)
        return out

    return per_island(spans, doc, chosen)


def lab_results(docs: DataFrame, anchors: DataFrame, doc: str, text: str, most: int = 100) -> DataFrame:
    """(doc, anchor_start, start, end, value): the result right of each anchor, up to the next anchor or clause end.

    A number right after the anchor (a sign and a unit may go with it), else the first qualitative word.
    """
    w = W.partitionBy(doc).orderBy("start", "end")
    a = anchors.select(doc, "start", "end").distinct().withColumn("next", F.lead("start").over(w))
    held = docs.select(doc, text).join(a, doc)
    scope = F.regexp_extract(F.substr(text, F.col("end") + 1, F.least(F.lit(most), F.coalesce(F.col("next"), F.length(text)) - F.col("end"))), r"^([^\n\r;]*?)(?:\.\s|[\n\r;]|\z)", 1)
    held = held.withColumn("scope", scope)
    number = r"(?iU)^(\s*(?:[:=]|là|is|was)?\s*)([<>]?\s*\d+(?:[.,/]\d+)*(?:\s*(?:%|mmhg|mmol/l|mg/dl|g/dl|g/l|ng/ml|meq/l|iu/l|u/l))?)(?!\w)"
    quality = r"(?iU)^(.*?(?<!\w))(dương\s+tính|âm\s+tính|bình\s+thường|bất\s+thường|tăng|giảm|cao|thấp|positive|negative|normal|abnormal|elevated|high|low)(?!\w)"
    pick = lambda g: F.when(F.col("scope").rlike(number), F.regexp_extract("scope", number, g)).otherwise(F.regexp_extract("scope", quality, g))
    found = held.withColumn("lead", pick(1)).withColumn("value", pick(2)).where("value <> ''")
    start = F.col("end") + F.length("lead")
    return found.select(doc, F.col("start").alias("anchor_start"), start.alias("s"), (start + F.length("value")).alias("e"), "value").withColumnsRenamed({"s": "start", "e": "end"})


def list_items(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, item, start, end, indication_start, indication_end): list items, with what follows an indication word apart."""
    ls = lines(docs, doc, text).withColumn("mark", F.length(F.regexp_extract("value", ITEM, 0))).where("mark > 0")
    body = F.regexp_replace(F.substr("value", F.col("mark") + 1), r"\s+$", "")
    ls = ls.withColumn("body", body).where("body <> ''").withColumn("begin", F.col("start") + F.col("mark"))
    head = F.regexp_extract("body", rf"^(.*?)(?:{INDICATION})", 1)
    cue = F.regexp_extract("body", rf"^(.*?(?:{INDICATION}))", 1)
    has = F.length(cue) > 0
    end = F.col("begin") + F.length("body")
    first = F.col("begin") + F.length(cue)
    return ls.where(~has | (F.length(head) > 0)).select(
        doc, F.col("line").alias("item"), F.col("begin").alias("start"), F.when(has, F.col("begin") + F.length(head)).otherwise(end).alias("end"),
        F.when(has & (first < end), first).alias("indication_start"), F.when(has & (first < end), end).alias("indication_end"),
    )


#: Parts that may follow a drug's name, in the order they are tried (fixed values); ``+`` needs a part before it.
COMPONENTS = (
    ("administered_dose", r"\s*,?\s*\d+(?:[.,]\d+)?(?:\s*-\s*\d+(?:[.,]\d+)?)?(?:\s*/\s*\d+(?:[.,]\d+)?)?\s*(?:mg|g|gram|mcg|microgram|ml|meq|iu|u|đơn\s+vị|units?)(?:\s*/\s*(?:ml|l|kg|ngày|day|lần|dose))?(?!\w)"),
    ("release", r"\s*(?:xl|xr|er|sr|cr|ir|extended\s+release|sustained\s+release)\b"),
    ("dose_form", r"\s*(?:viên\s+nang|viên\s+nén|dung\s+dịch|khí\s+dung|oral\s+suspension|suspensions?|capsules?|tablets?|injections?|solutions?|inhalers?|nebulizers?|nebs?)\b"),
    ("route", r"\s*(?:po|p\.o\.|iv|i\.v\.|im|sc|sl|uống|đường\s+uống|tiêm\s+tĩnh\s+mạch|truyền\s+tĩnh\s+mạch|tĩnh\s+mạch|hít|xịt|dán|nhỏ)\b"),
    ("frequency", r"\s*(?::?\s*)?(?:bid|tid|qid|qhs|qam|qd|q\s*\d+\s*h|daily|once|prn|liên\s+tục|hằng\s+ngày|hàng\s+ngày|mỗi\s+ngày|mỗi\s+\d+\s*(?:giờ|phút)|every\s+\d+\s*(?:hours?|minutes?)|\d+\s*lần\s*/\s*ngày)\b"),
    ("dosage", r"\s*x\s*\d+\b"),
    ("dosage", r"\s+\d+\s*(?:lần|liều|viên|tablets?|capsules?|puffs?)\b"),
    ("duration+", r"\s+trong\s+\d+(?:[.,]\d+)?\s*(?:ngày|days?|tuần|weeks?|tháng|months?)\b"),
    ("context+", r"\s+tại\s+nhà\b"),
    ("context+", r"\s*\([^)\n\r]{1,50}\)"),
)


def grow_mentions(docs: DataFrame, anchors: DataFrame, doc: str, text: str, most: int = 160) -> DataFrame:
    """(doc, start, end, full_end, components): anchors grown over the parts that follow them without a gap.

    Only the ``most`` characters after an anchor are sent to Python; a line end or semicolon stops the walk.
    """
    held = docs.select(doc, text).join(anchors.select(doc, "start", "end").distinct(), doc)
    held = held.select(doc, "start", "end", F.regexp_extract(F.substr(text, F.col("end") + 1, F.lit(most)), r"^([^\n\r;]*)", 1).alias("tail"))
    kind = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(kind)
    def walk(tails: pd.Series) -> pd.Series:
        parts = [(k, re.compile(p, re.I)) for k, p in COMPONENTS]
        out = []
        for t in tails:
            at, got = 0, []
            while at < len(t):
                hit = next(((k, m) for k, p in parts if (got or not k.endswith("+")) and (m := p.match(t, at)) and m.end() > at), None)
                if hit is None:
                    break
                k, m = hit
                raw = m[0]
                s = at + len(raw) - len(raw.lstrip(" ,"))
                e = at + len(raw.rstrip(" ,"))
                if e > s:
                    got.append({"kind": k.rstrip("+"), "start": s, "end": e})
                at = m.end()
            out.append(got)
        return pd.Series(out)

    held = held.withColumn("c", walk("tail"))
    parts = F.transform("c", lambda x: F.struct(x["kind"].alias("kind"), (x["start"] + F.col("end")).alias("start"), (x["end"] + F.col("end")).alias("end")))
    return held.select(doc, "start", "end", parts.alias("components")).withColumn("full_end", F.coalesce(F.get("components", F.size("components") - 1)["end"], F.col("end")))


def expand(docs: DataFrame, spans: DataFrame, doc: str, text: str, before: str, after: str, times: int = 3, reach: int = 40, bonus: float = 0.04) -> DataFrame:
    """``spans`` (start, end, score) grown over an allowed modifier before them and up to ``times`` after them.

    ``before`` and ``after`` are patterns of one modifier with its blank; they never cross a line or a clause sign.
    Only grown spans are returned, with a score higher by ``bonus`` (0.98 at most).
    """
    held = docs.select(doc, text).join(spans, doc)
    left = F.regexp_extract(F.substr(text, F.greatest(F.col("start") - reach, F.lit(0)) + 1, F.least(F.col("start"), F.lit(reach))), rf"(?iU)(?<!\w)((?:{before}))$", 1)
    right = F.regexp_extract(F.substr(text, F.col("end") + 1, F.lit(reach * times)), rf"(?iU)^((?:(?:{after})(?!\w)){{0,{times}}})", 1)
    held = held.withColumn("_s", F.col("start") - F.length(left)).withColumn("_e", F.col("end") + F.length(right)).where("_s < start or _e > end")
    score = F.least(F.lit(0.98), F.col("score") + bonus)
    return held.select(doc, F.col("_s").alias("start"), F.col("_e").alias("end"), score.alias("score"), *[c for c in spans.columns if c not in (doc, "start", "end", "score")])


def lab_pairs(docs: DataFrame, doc: str, text: str, headings: str = r"(?i)^\s*(?:labs?|laboratory results?|xét nghiệm|cận lâm sàng)\s*:*\s*$", others: str = r"(?U)^\s*[\w ]{3,40}:\s*$") -> DataFrame:
    """(doc, start, end, result_start, result_end, in_section): name and value pairs of a line's segments.

    A name followed by a colon, an equals sign or an arrow pairs with the number after it; under a laboratory heading,
    up to the next heading, a blank is enough.  The heading in force is carried forward over the lines.
    """
    ls = lines(docs, doc, text)
    state = F.when(F.col("value").rlike(headings), F.lit(True)).when(F.col("value").rlike(others), F.lit(False))
    w = W.partitionBy(doc).orderBy("line")
    ls = ls.withColumn("_h", state).withColumn("in_section", F.coalesce(F.last("_h", ignorenulls=True).over(w), F.lit(False))).where("_h is null and value rlike '[0-9]'")
    seg = ls.select(doc, "in_section", F.col("start").alias("_at"), F.explode(tiles(F.col("value"), r"[^,;]+")).alias("m"))
    name = r"^(\s*(?:[-*•]\s*)?)([\p{L}][\p{L}\p{N} /()-]{0,38}?)"
    number = r"([<>]?\s?\d+(?:[.,]\d+)*(?:\s?(?:%|mmhg|mmol/l|mg/dl|g/dl|g/l|ng/ml|meq/l|iu/l|u/l))?)\s*$"
    strict, loose = rf"(?i){name}(\s*(?::|=|→|-->?|->)\s*){number}", rf"(?i){name}(\s+){number}"
    pick = lambda g: F.when(F.col("m.value").rlike(strict), F.regexp_extract("m.value", strict, g)).when(F.col("in_section"), F.regexp_extract("m.value", loose, g)).otherwise("")
    seg = seg.select(doc, "in_section", (F.col("_at") + F.col("m.start")).alias("at"), *[pick(g).alias(f"g{g}") for g in (1, 2, 3, 4)]).where("g2 <> '' and g4 <> ''")
    start = F.col("at") + F.length("g1")
    end = start + F.length("g2")
    return seg.select(doc, start.alias("start"), end.alias("end"), (end + F.length("g3")).alias("result_start"), (end + F.length("g3") + F.length("g4")).alias("result_end"), "in_section")


def project_labels(tokens: DataFrame, doc: str, thresholds: dict[str, float], default: float = 0.5) -> DataFrame:
    """(doc, type, start, end, score): spans of token predictions (start, end, label, score), one best row per token.

    BIO or BIOES labels; a span's score is its tokens' mean, and the type's threshold applies before any overlap is
    resolved.
    """
    best = tokens.withColumn("_r", F.row_number().over(W.partitionBy(doc, "start", "end").orderBy(F.desc("score"), "label"))).where("_r = 1")
    w = W.partitionBy(doc).orderBy("start", "end")
    kind, tag = F.when(F.col("label") != "O", F.substring("label", 3, 1000)), F.substring("label", 1, 1)
    t = best.withColumn("type", kind).withColumn("tag", tag).withColumn("pt", F.lag("type").over(w)).withColumn("pg", F.lag("tag").over(w))
    opens = F.col("type").isNotNull() & (F.col("tag").isin("B", "S") | F.col("pt").isNull() | (F.col("pt") != F.col("type")) | F.col("pg").isin("E", "S"))
    t = t.withColumn("span", F.sum(opens.cast("int")).over(w)).where("type is not null")
    spans = t.groupBy(doc, "span", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score")).drop("span")
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("type")), F.lit(default)) if thresholds else F.lit(default)
    return spans.where(F.col("score") >= least)


def hybrid(rules: DataFrame, model: DataFrame, doc: str, least: float = 0.5) -> DataFrame:
    """Rule spans, and model spans of enough confidence that overlap none of them; equal spans keep both sources.

    One sort of both tables decides which model spans are free, so no pairs are made.
    """
    key = [doc, "start", "end", "type"]
    sure = model.where(F.col("score") >= least)
    both = rules.select(*key, "score", F.lit("rule").alias("source")).unionByName(sure.select(*key, "score", F.lit("model").alias("source")))
    merged = both.groupBy(*key).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    ruled = F.array_contains("sources", "rule")
    w = W.partitionBy(doc).orderBy("start", F.desc(ruled), "end")
    seen = F.max(F.when(ruled, F.col("end"))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.min(F.when(ruled, F.col("start"))).over(w.rowsBetween(1, W.unboundedFollowing))
    held = merged.withColumn("_seen", seen).withColumn("_after", after)
    return held.where(ruled | (F.coalesce(F.col("_seen") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_after") >= F.col("end"), F.lit(True)))).drop("_seen", "_after")


def deduplicate(spans: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One span per key: the first by ``order``."""
    return spans.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def resolve(proposals: DataFrame, doc: str) -> DataFrame:
    """Every distinct proposal with ``decision``: selected, unresolved_type, contained_exactly or lower_utility.

    ``proposals``: doc, start, end, type (null: ambiguous), source, score, atomic, nested.  Equal spans of one type are one
    candidate, scored by its best score and its sources.  A candidate that lies in an atomic one of the same type, and is
    not atomic itself, gives way to it; the rest is the set of greatest utility, island by island.
    """
    key = [doc, "start", "end", "type"]
    merged = proposals.where("type is not null").groupBy(*key).agg(
        F.max("score").alias("score"), F.count_distinct("source").alias("sources"), F.max(F.coalesce("atomic", F.lit(False))).alias("atomic"), F.max(F.coalesce("nested", F.lit(0))).alias("nested")
    )
    w = W.partitionBy(doc, "type").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    held = merged.withColumn("_cover", F.max(F.when(F.col("atomic"), F.col("end"))).over(w))
    inner = ~F.col("atomic") & F.coalesce(F.col("_cover") >= F.col("end"), F.lit(False))
    utility = F.round(proposal_utility(F.col("score"), F.col("sources"), F.col("atomic"), F.col("nested")), 9)
    held = held.withColumn("_inner", inner).withColumn("weight", utility).drop("_cover")
    free = held.where("not _inner and weight > 0").select(*key, "weight")
    chosen = resolve_weighted(free, doc).select(*key).withColumn("_chosen", F.lit(True))
    decided = held.join(chosen, key, "left").withColumn("decision", F.when(F.col("_chosen"), "selected").when(F.col("_inner"), "contained_exactly").otherwise("lower_utility"))
    open_ = proposals.where("type is null").select(doc, "start", "end", "type", "score").distinct().withColumn("decision", F.lit("unresolved_type"))
    cols = [*key, "score", "decision"]
    return decided.select(*cols).unionByName(open_.select(*cols))


def glued_aliases(matches: DataFrame, docs: DataFrame, doc: str, text: str, prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Dictionary matches without boundaries (doc, start, end, ...) that are glued to another match or to a known word part.

    A side is free if no letter or digit stands there, or if another match ends or begins there, or a part of ``prefixes`` or
    ``suffixes`` does; one side at least must be glued.  Neighbours are found by equal places, so no pairs are made.
    """
    held = matches.join(docs.select(doc, F.col(text).alias("_text")), doc)
    ends = matches.select(doc, F.col("end").alias("start")).distinct().withColumn("_l", F.lit(True))
    starts = matches.select(doc, F.col("start").alias("end")).distinct().withColumn("_r", F.lit(True))
    held = held.join(ends, [doc, "start"], "left").join(starts, [doc, "end"], "left")
    before, after = F.lower(F.substr("_text", F.lit(1), F.col("start"))), F.lower(F.substr("_text", F.col("end") + 1, F.lit(40)))
    tail = before.rlike("(?U)(?<!\\w)(?:" + "|".join(prefixes) + ")$") if prefixes else F.lit(False)
    head = after.rlike("(?U)^(?:" + "|".join(suffixes) + ")(?!\\w)") if suffixes else F.lit(False)
    left, right = F.coalesce("_l", F.lit(False)) | tail, F.coalesce("_r", F.lit(False)) | head
    open_left, open_right = ~before.rlike(r"(?U)[\p{L}\p{N}]$") | left, ~after.rlike(r"(?U)^[\p{L}\p{N}]") | right
    return held.where(open_left & open_right & (left | right)).withColumn("score", F.lit(0.74)).select(*matches.columns, "score")


def gated_aliases(matches: DataFrame, gates: DataFrame, rules: DataFrame, doc: str) -> DataFrame:
    """Short aliases admitted by context: matches (doc, start, end, rule_id) of ``rules`` (rule_id, required) with a gate.

    ``gates`` (doc, start, end, gate) are the stretches where a piece of structural evidence holds: a section, a list item, a
    line, the surroundings of a drug.  A match needs one of its rule's gates around it; ``accepted`` lists them.
    """
    r = F.broadcast(rules.select("rule_id", F.explode("required").alias("gate")))
    asked = matches.join(r, "rule_id")
    g = gates.select(doc, "gate", F.col("start").alias("_gs"), F.col("end").alias("_ge")).distinct()
    tagged = asked.select(doc, "gate", "start", "end", "rule_id", F.lit(1).alias("_m")).unionByName(g.select(doc, "gate", F.col("_gs").alias("start"), F.col("_ge").alias("end"), F.lit(None).cast("string").alias("rule_id"), F.lit(0).alias("_m")))
    w = W.partitionBy(doc, "gate").orderBy("start", "_m").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = tagged.withColumn("_cover", F.max(F.when(F.col("_m") == 0, F.col("end"))).over(w)).where("_m = 1 and _cover >= end")
    accepted = held.groupBy(doc, "start", "end", "rule_id").agg(F.array_sort(F.collect_set("gate")).alias("accepted"))
    return matches.join(accepted, [doc, "start", "end", "rule_id"]).withColumn("score", F.lit(0.72))


def resolve_types(spans: DataFrame, docs: DataFrame, doc: str, text: str, cues: dict[str, tuple[str, str]], pair: tuple[str, str] = ("DISEASE", "SYMPTOM"), radius: int = 64) -> DataFrame:
    """``spans`` (doc, start, end, types) with (type, reason): one of the types an extractor proposed, or none.

    ``cues``: per type a pattern for the text before and one for the text after.  A single type stands; of ``pair`` the one
    whose cue before the span is nearest; otherwise the first type, in the order of ``cues``, that has a cue.
    """
    held = spans.join(docs.select(doc, F.col(text).alias("_text")), doc)
    lo = F.greatest(F.col("start") - radius, F.lit(0))
    left, right = F.substr("_text", lo + 1, F.col("start") - lo), F.substr("_text", F.col("end") + 1, F.lit(radius))
    gap = lambda t: F.when(left.rlike(cues[t][0]), F.length(left) - F.coalesce(F.element_at(tiles(left, cues[t][0]), -1)["end"], F.lit(0)))
    one, two = pair
    both = F.array_contains("types", one) & F.array_contains("types", two) & (F.size("types") == 2)
    a, b = (gap(t) if t in cues else F.lit(None).cast("int") for t in pair)
    nearest = F.when(b.isNotNull() & (a.isNull() | (b < a)), two).when(a.isNotNull(), one)
    other = F.coalesce(*[F.when(F.array_contains("types", t) & (left.rlike(p) | right.rlike(q)), F.lit(t)) for t, (p, q) in cues.items() if t not in pair], F.lit(None).cast("string"))
    kind = F.when(F.size("types") == 1, F.get("types", F.lit(0))).when(both, nearest).otherwise(other)
    reason = F.when(F.size("types") == 1, "unique_type").when(kind.isNotNull(), "context").otherwise("context_missing")
    return held.withColumn("type", kind).withColumn("reason", reason).drop("_text")


def number_entities(spans: DataFrame, doc: str, kind: str = "type") -> DataFrame:
    """``spans`` with ids E1, E2, ... by place and type within each document."""
    return spans.withColumn("entity_id", F.concat(F.lit("E"), F.row_number().over(W.partitionBy(doc).orderBy("start", "end", kind)).cast("string")))


def run_rules(docs: DataFrame, foundation: list, dependent: list, doc: str) -> DataFrame:
    """The rule engine: foundation extractors see documents, dependent ones also what was found, one resolution decides.

    An extractor is a function of documents (and proposals) to proposals (doc, start, end, type, source, score, atomic,
    nested); selected spans are numbered by place.
    """
    found = foundation[0](docs)
    for f in foundation[1:]:
        found = found.unionByName(f(docs))
    whole = found
    for f in dependent:
        whole = whole.unionByName(f(docs, found))
    return number_entities(resolve(whole, doc).where("decision = 'selected'").drop("decision"), doc)


def render_scenarios(rows: DataFrame, template: str = "template", entities: str = "entities") -> DataFrame:
    """``rows`` with (text, spans, problem): templates with ``{id}`` places filled from ``entities`` (map id to surface).

    Offsets are sums over the pieces; an id without an entity, or an entity without a place, is a ``problem``.
    """
    place = r"\{([A-Za-z0-9_]+)\}"
    ids = F.regexp_extract_all(template, F.lit(place), F.lit(1))
    gaps = F.split(template, place, -1)
    parts = F.flatten(F.zip_with(gaps, ids, lambda g, i: F.array(F.struct(g.alias("text"), F.lit(None).cast("string").alias("id")), F.struct(F.element_at(entities, i).alias("text"), i.alias("id")))))
    kept = F.filter(parts, lambda p: p["text"].isNotNull())
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<id:string,start:int,end:int>>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p["text"])).alias("at"), F.when(p["id"].isNull(), a["out"]).otherwise(F.array_append(a["out"], F.struct(p["id"].alias("id"), a["at"].alias("start"), (a["at"] + F.length(p["text"])).alias("end")))).alias("out"))
    keys = F.map_keys(entities)
    problem = F.when(F.size(F.array_except(ids, keys)) > 0, "unknown_entity").when(F.size(F.array_except(keys, ids)) > 0, "missing_entity")
    return rows.withColumns({"text": F.array_join(F.transform(kept, lambda p: p["text"]), ""), "spans": F.aggregate(kept, begin, step, lambda a: a["out"]), "problem": problem})
