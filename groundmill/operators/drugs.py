"""Drug mentions and products: query variants, strengths and their roles, forms, routes and release, and compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmill.functions.text import squeeze, tiles

# Units, cues of forms, routes and release, words of administration, and weights of the score.
UNITS = "mcg|µg|μg|mg|gm|g|ml|meq|iu|u"
NUMBER = r"(?:\d+(?:[.,]\d+)?|[.,]\d+)"
STRENGTH = rf"(?iU)(?<!\w){NUMBER}(?:\s*-\s*{NUMBER})?\s*(?:{UNITS})(?:\s*/\s*(?:{NUMBER}\s*)?(?:ml|l|kg|day|ngày|dose|lần))?(?!\w)"
FORMS = {
    "capsule": ("capsule", "capsules", "viên nang"), "inhaler": ("inhaler", "nebs", "nebulizer", "khí dung"), "injection": ("injection", "injectable"),
    "solution": ("solution", "syrup", "dung dịch", "dịch truyền"), "suspension": ("suspension", "oral suspension", "hỗn dịch"), "tablet": ("tablet", "tablets", "viên nén", "viên"),
}
ROUTES = {
    "oral": ("po", "p.o.", "oral", "uống", "đường uống"), "intravenous": ("iv", "i.v.", "tiêm tĩnh mạch", "truyền tĩnh mạch", "tĩnh mạch"), "intramuscular": ("im", "i.m.", "tiêm bắp"),
    "subcutaneous": ("sc", "s.c.", "tiêm dưới da"), "sublingual": ("sl", "s.l.", "ngậm dưới lưỡi"), "inhaled": ("hít", "xịt"), "topical": ("bôi", "dán", "nhỏ"),
}
RELEASES = {
    "extended": ("extended release", "sustained release", "controlled release", "giải phóng kéo dài", "xr", "er", "sr", "cr", "xl"),
    "immediate": ("immediate release", "giải phóng tức thì", "ir"),
}
SIG = r"(?iU)(?<!\w)(?:bid|tid|qid|qhs|qam|qd|daily|prn|mỗi\s+ngày|hằng\s+ngày|hàng\s+ngày|mỗi\s+\d+\s*(?:giờ|phút))(?!\w)"
ADMINISTRATION = r"(?iU)(?<!\w)(?:dùng|uống|tiêm|truyền|bổ\s+sung|received|administered|given)(?!\w)"
ADMINISTRATION_WORDS = (
    "bid capsule capsules daily dose doses duong đường extended frequency gm gram grams hang hằng hàng im inhaler injection injectable intramuscular "
    "intravenous iv lan lần mcg meq mg ml morning ngay ngày nebs nebulizer once oral po prn qam qd qhs qid release route sc sl solution sr suspension "
    "tablet tablets tid tinh tĩnh truyen truyền uong uống xl xr"
).split()
WEIGHTS = {"lexical": 0.35, "dense": 0.20, "identity": 0.20, "structure": 0.15, "prior": 0.10}
PRIORS = {"reviewed_memory": 1.0, "exact": 1.0, "toneless": 0.92, "abbreviation": 0.90, "dense": 0.70, "fuzzy": 0.65, "char_ngram": 0.55, "bm25": 0.50}
BONUS = {"ingredient_exact": 0.30, "brand_exact": 0.15, "product_strength_exact": 0.30, "dose_form_exact": 0.15, "release_exact": 0.20, "administered_dose_match": 0.02}
PENALTY = {"brand_mismatch": 0.15, "brand_evidence_missing": 0.10, "ambiguous_strength": 0.05, "route_only_discrepancy": 0.02, "administered_dose_discrepancy": 0.02}


def query_variants(key: Column) -> Column:
    """Lower-priority queries of a drug's normal form: array<struct<text,kind,weight>>, at most two, never the key itself.

    One writes units, grams and the oral route as labels do; one drops strength, route, form and frequency.
    """
    typo = F.regexp_replace(key, rf"(?iU)(?<=\d)(?=(?:{UNITS})\b)", " ")
    typo = F.regexp_replace(F.regexp_replace(typo, r"(?iU)\bgrams?\b", "gm"), r"(?iU)(?<!\w)(?:p\.?o\.?|đường\s+uống|uong|uống)(?!\w)", "oral")
    typo = squeeze(typo)
    words = F.regexp_extract_all(F.regexp_replace(typo, STRENGTH, " "), F.lit(r"(?U)[^\W_]+(?:[-./][^\W_]+)*"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(ADMINISTRATION_WORDS) & ~w.rlike(r"(?i)^(?:x|q)?\d+(?:h|min)?$"))
    core = F.when(F.exists(kept, lambda w: F.length(w) >= 3), F.array_join(kept, " "))
    one = lambda text, kind, weight: F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
    return F.array_compact(F.array(F.when(typo != key, one(typo, "medication_typography", 0.99)), F.when(core.isNotNull() & (core != key) & (core != typo), one(core, "medication_core", 0.65))))


def _cued(text: Column, cues: dict[str, tuple[str, ...]]) -> Column:
    found = [F.when(text.rlike(r"(?iU)(?<!\w)(?:" + "|".join(w.replace(".", r"\.").replace(" ", r"\s+") for w in words) + r")(?!\w)"), F.lit(name)) for name, words in cues.items()]
    return F.array_compact(F.array(*found))


def _strength(value: Column) -> Column:
    """A strength without blanks, a point for a comma, and one spelling per unit."""
    x = F.regexp_replace(F.lower(value), r"(?U)\s+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(\d),(\d)", "$1.$2"), r"(\d+)\.0+(?=[a-zµμ-])", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[µμ]g", "mcg"), r"gm(?![a-z])", "g"), r"^[.]", "0.")


def structure(text: Column, product: bool = False) -> Column:
    """struct<product,ambiguous,administered,forms,routes,releases>: arrays of a mention's or a product's attributes.

    A mention's strength is the product's if a form or release stands within a few words after it, administered if a word
    of administration stands before it, or a frequency after it without a form; otherwise it is ambiguous.
    """
    low = F.lower(text)
    hits = tiles(text, STRENGTH)

    def role(m: Column) -> Column:
        after = F.substr(text, m["end"] + 1, F.lit(28))
        before = F.substr(text, F.greatest(m["start"] - 28, F.lit(0)) + 1, F.least(m["start"], F.lit(28)))
        formed = (F.size(_cued(after, FORMS)) > 0) | (F.size(_cued(after, RELEASES)) > 0)
        given = before.rlike(ADMINISTRATION) | after.rlike(SIG)
        return F.when(F.lit(product) | formed, "product").when(given, "administered").otherwise("ambiguous")

    roles = F.transform(hits, lambda m: F.struct(role(m).alias("role"), _strength(m["value"]).alias("value")))
    of = lambda r: F.array_sort(F.array_distinct(F.transform(F.filter(roles, lambda x: x["role"] == r), lambda x: x["value"]))).alias(r)
    return F.struct(of("product"), of("ambiguous"), of("administered"), _cued(low, FORMS).alias("forms"), _cued(low, ROUTES).alias("routes"), _cued(low, RELEASES).alias("releases"))


def names_of(value: Column) -> Column:
    """The ingredients of a combination, as a sorted set of normal forms."""
    parts = F.split(F.lower(F.coalesce(value, F.lit(""))), r"(?U)\s*(?:/|\+|\band\b|\bvà\b)\s*")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")))


def rerank(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """``candidates`` (mention_id, mention, concept_id, lexical, dense, source) with (score, conflict, reasons, rank).

    ``products``: concept_id, name, ingredient, brand, tty.  Ingredients and brands of the retrieved products that stand in
    the mention are its identity; another ingredient, release, form or explicit product strength is a conflict and takes
    no rank.  Everything else is a bonus or a penalty; scores lie in [0, 1].
    """
    p = products.select("concept_id", F.col("name").alias("_name"), "brand", names_of(F.col("ingredient")).alias("_own"), structure(F.col("name"), True).alias("_p"))
    c = candidates.join(p, "concept_id").withColumn("_m", structure(F.col("mention")))
    in_mention = lambda x: F.rlike(F.lower("mention"), F.concat(F.lit(r"(?U)(?<!\w)\Q"), x, F.lit(r"\E(?!\w)")))
    seen = F.filter("_own", lambda x: in_mention(x))
    brand = F.when(in_mention(F.lower("brand")), F.lower("brand"))
    of = W.partitionBy("mention_id")
    c = c.withColumn("_ing", F.array_sort(F.array_distinct(F.flatten(F.collect_set(seen).over(of))))).withColumn("_brands", F.collect_set(brand).over(of))
    differ = lambda k: (F.size(F.col(f"_m.{k}")) > 0) & (F.size(F.col(f"_p.{k}")) > 0) & ~F.arrays_overlap(F.col(f"_m.{k}"), F.col(f"_p.{k}"))
    same = lambda k: (F.size(F.col(f"_m.{k}")) > 0) & (F.array_sort(F.col(f"_m.{k}")) == F.array_sort(F.col(f"_p.{k}")))
    named = F.size("_ing") > 0
    conflict = (
        F.when(named & (F.size("_own") == 0), "ingredient_missing").when(named & (F.size("_ing") != F.size("_own")), "ingredient_count_mismatch").when(named & (F.col("_ing") != F.col("_own")), "ingredient_mismatch")
        .when(differ("releases"), "release_mismatch").when(differ("forms"), "dose_form_mismatch").when(differ("product"), "product_strength_mismatch")
    )
    branded = (F.size("_brands") > 0) & F.col("brand").isNotNull()
    has_brand = F.array_contains("_brands", F.lower("brand"))
    given = F.size("_m.administered") > 0
    given_same = F.arrays_overlap(F.col("_m.administered"), F.col("_p.product"))
    loose = (F.size("_m.ambiguous") > 0) & (F.size("_p.product") > 0) & ~F.arrays_overlap(F.col("_m.ambiguous"), F.col("_p.product"))
    rules = {
        "ingredient_exact": named & (F.col("_ing") == F.col("_own")), "brand_exact": branded & has_brand, "brand_mismatch": branded & ~has_brand,
        "brand_evidence_missing": (F.size("_brands") == 0) & F.col("brand").isNotNull(), "product_strength_exact": same("product"), "dose_form_exact": same("forms"), "release_exact": same("releases"),
        "administered_dose_match": given & given_same, "administered_dose_discrepancy": given & (F.size("_p.product") > 0) & ~given_same, "ambiguous_strength": loose, "route_only_discrepancy": differ("routes"),
    }
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()])))
    identity = F.when(F.coalesce(rules["ingredient_exact"], F.lit(False)), 1.0).when(F.coalesce(rules["brand_exact"], F.lit(False)), 0.8).when(named, 0.0).otherwise(0.5)
    held = [F.when(F.size(F.col(f"_m.{k}")) == 0, 0.5).when(F.arrays_overlap(F.col(f"_m.{k}"), F.col(f"_p.{k}")), 1.0).otherwise(0.0) for k in ("product", "forms", "releases")]
    prior = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORS.items() for x in kv]), F.col("source")), F.lit(0.0))
    change = F.aggregate("reasons", F.lit(0.0), lambda a, r: a + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (BONUS | {k: -v for k, v in PENALTY.items()}).items() for x in kv]), r), F.lit(0.0)))
    base = WEIGHTS["lexical"] * F.col("lexical") + WEIGHTS["dense"] * F.coalesce("dense", "lexical") + WEIGHTS["identity"] * identity + WEIGHTS["structure"] * sum(held) / 3 + WEIGHTS["prior"] * prior
    c = c.withColumn("reasons", reasons).withColumn("conflict", conflict).withColumn("score", F.when(F.col("conflict").isNotNull(), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + change)), 6)))
    rank = F.when(F.col("conflict").isNull(), F.row_number().over(of.orderBy(F.col("conflict").isNotNull(), F.desc("score"), "concept_id")))
    return c.withColumn("rank", rank).select(*candidates.columns, "score", "conflict", "reasons", "rank")
