import pytest
from pyspark.sql import functions as F

from groundmill.operators import drugs, proposals
from groundmill.plans import stages


def test_query_variants(spark):
    df = spark.createDataFrame([("aspirin 81mg po daily",), ("aspirin",), ("5 mg tablet",), ("vitamin d 2 grams uống",)], "k string")
    got = {r.k: [(v.text, v.kind, v.weight) for v in r.v] for r in df.select("k", drugs.query_variants(F.col("k")).alias("v")).collect()}
    assert got["aspirin 81mg po daily"] == [("aspirin 81 mg oral daily", "medication_typography", 0.99), ("aspirin", "medication_core", 0.65)]
    assert got["aspirin"] == [] and got["5 mg tablet"] == []
    assert [v[0] for v in got["vitamin d 2 grams uống"]] == ["vitamin d 2 gm oral", "vitamin d"]


def test_structure(spark):
    texts = ["metformin 500 mg tablet", "given heparin 5000 iu", "aspirin 81 mg po daily", "insulin 2,5 ml", "metformin xr 1000 mg", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", drugs.structure(F.col("t")).alias("s")).collect()}
    assert got[texts[0]].product == ["500mg"] and got[texts[0]].forms == ["tablet"]
    assert got[texts[1]].administered == ["5000iu"] and got[texts[2]].administered == ["81mg"] and got[texts[2]].routes == ["oral"]
    assert got[texts[3]].ambiguous == ["2.5ml"] and got[texts[4]].releases == ["extended"] and got[""].product == []


def test_rerank(spark):
    products = spark.createDataFrame([
        ("p1", "metformin 500 mg oral tablet", "metformin", None, "SCD"), ("p2", "metformin 1000 mg oral tablet", "metformin", None, "SCD"), ("p3", "metformin 500 mg extended release tablet", "metformin", None, "SCD"),
        ("p4", "glipizide 5 mg / metformin 500 mg oral tablet", "glipizide / metformin", None, "SCD"), ("p5", "metformin", "metformin", None, "IN"), ("p6", "metformin 500 mg tablet [Gluco]", "metformin", "Gluco", "SBD"),
    ], "concept_id string, name string, ingredient string, brand string, tty string")
    c = products.select(F.lit(1).alias("mention_id"), F.lit("metformin 500 mg tablet").alias("mention"), "concept_id", F.lit(0.3).alias("lexical"), F.lit(None).cast("double").alias("dense"), F.lit("bm25").alias("source"))
    got = {r.concept_id: r for r in drugs.rerank(c, products).collect()}
    assert got["p2"].conflict == "product_strength_mismatch" and got["p4"].conflict == "ingredient_count_mismatch" and got["p2"].rank is None
    assert got["p1"].rank == 1 and "product_strength_exact" in got["p1"].reasons and got["p6"].rank > 1 and "brand_evidence_missing" in got["p6"].reasons
    assert got["p5"].score < got["p1"].score == 1.0  # bounded


def test_glued_and_gated_aliases(spark):
    docs = spark.createDataFrame([(1, "aspirinheparin x paracetamolum 12 heparin")], "doc int, text string")
    m = spark.createDataFrame([(1, 0, 7), (1, 7, 14), (1, 17, 28), (1, 34, 41)], "doc int, start int, end int")
    assert {(r.start, r.end) for r in proposals.glued_aliases(m, docs, "doc", "text").collect()} == {(0, 7), (7, 14)}
    assert {(r.start, r.end) for r in proposals.glued_aliases(m, docs, "doc", "text", suffixes=("um",)).collect()} == {(0, 7), (7, 14), (17, 28)}
    rules = spark.createDataFrame([("r", ["lab", "list"])], "rule_id string, required array<string>")
    gates = spark.createDataFrame([(1, 0, 14, "lab"), (1, 30, 50, "drug")], "doc int, start int, end int, gate string")
    got = proposals.gated_aliases(m.withColumn("rule_id", F.lit("r")), gates, rules, "doc").collect()
    assert {(r.start, tuple(r.accepted)) for r in got} == {(0, ("lab",)), (7, ("lab",))}


def test_types_numbers_and_scenarios(spark):
    docs = spark.createDataFrame([(1, "chẩn đoán: viêm phổi. triệu chứng: sốt, ho; dùng cam")], "doc int, text string")
    t = "chẩn đoán: viêm phổi. triệu chứng: sốt, ho; dùng cam"
    span = lambda w: (1, t.index(w), t.index(w) + len(w))
    rows = [(*span("viêm phổi"), ["DISEASE", "SYMPTOM"]), (*span("sốt"), ["DISEASE", "SYMPTOM"]), (*span("ho;"), ["SYMPTOM"]), (*span("cam"), ["DRUG", "FOOD"]), (*span("chẩn"), ["DISEASE", "SYMPTOM"])]
    cues = {"DISEASE": ("(?iU)chẩn đoán", "$^"), "SYMPTOM": ("(?iU)triệu chứng", "$^"), "DRUG": (r"(?iU)dùng\s*$", "$^")}
    got = proposals.resolve_types(spark.createDataFrame(rows, "doc int, start int, end int, types array<string>"), docs, "doc", "text", cues)
    assert {t[r.start : r.end]: (r.type, r.reason) for r in got.collect()} == {
        "viêm phổi": ("DISEASE", "context"), "sốt": ("SYMPTOM", "context"), "ho;": ("SYMPTOM", "unique_type"), "cam": ("DRUG", "context"), "chẩn": (None, "context_missing"),
    }
    assert [r.entity_id for r in proposals.number_entities(got.na.drop(subset=["type"]), "doc").orderBy("start").collect()] == ["E1", "E2", "E3", "E4"]
    s = spark.createDataFrame([("{a} with {b}, {a}.", {"a": "fever", "b": "cough"}), ("{z}", {"a": "x"}), ("none", {"a": "x"})], "template string, entities map<string,string>")
    out = proposals.render_scenarios(s).collect()
    assert out[0].text == "fever with cough, fever." and [(x.id, out[0].text[x.start : x.end]) for x in out[0].spans] == [("a", "fever"), ("b", "cough"), ("a", "fever")]
    assert [r.problem for r in out] == [None, "unknown_entity", "missing_entity"]


def test_rule_engine(spark):
    docs = spark.createDataFrame([(1, "Na 140 and HbA1c 7%")], "doc int, text string")
    more = lambda df, kind, score: df.select("doc", "start", "end", F.lit(kind).alias("type"), F.col("rule_id").alias("source"), F.lit(score).alias("score"), F.lit(False).alias("atomic"), F.lit(0).alias("nested"))
    number = lambda d: more(proposals.pattern_spans(d, {"number": r"\b\d+\b"}, "doc", "text"), "NUMBER", 0.6)
    lab = lambda d, found: more(proposals.pattern_spans(d, proposals.LAB_PATTERNS, "doc", "text"), "LAB_RESULT", 0.8)
    got = proposals.run_rules(docs, [number], [lab], "doc").orderBy("start").collect()
    assert [(r.entity_id, r.start, r.end, r.type) for r in got] == [("E1", 3, 6, "NUMBER"), ("E2", 11, 19, "LAB_RESULT")]


def test_plans_errors_and_batches(spark, tmp_path):
    made = []

    def first(_):
        made.append("first")
        return spark.range(5)

    def second(df):
        made.append("second")
        return df.where("id > 2")

    trace = stages.Trace()
    assert stages.run_plan(spark, str(tmp_path), [("a", first), ("b", second)], trace).count() == 2
    assert stages.run_plan(spark, str(tmp_path), [("a", first), ("b", second)]).count() == 2 and made == ["first", "second"]
    assert [(r.stage, r.rows) for r in trace.table(spark).collect()] == [("a", 5), ("b", 2)]
    got = {r.id: (r.x, r.error) for r in stages.with_errors(spark.range(3), lambda row: {"x": 6 // row["id"]}, "x int", "id").collect()}
    assert got[2] == (3, None) and got[0][1].startswith("ZeroDivisionError") and got[0][0] is None
    sizes = stages.label_in_batches(spark.range(10).coalesce(1), lambda b: b.assign(n=len(b)), "id long, n int", 4).collect()
    assert [(r.id, r.n) for r in sizes] == [(i, 4 if i < 8 else 2) for i in range(10)]
    assert stages.document_trace(spark.createDataFrame([("d", "abc")], "document_id string, text string"), {"signs": "length(text)"}).first().signs == 3
    with pytest.raises(Exception):
        stages.run_plan(spark, str(tmp_path), [("c", lambda _: spark.sql("select raise_error('x')"))])
