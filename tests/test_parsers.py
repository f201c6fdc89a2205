import io
import json
import zipfile

from groundmill.sources import parsers


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in members.items():
            z.writestr(n, x)
    return out.getvalue()


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_transcripts(spark):
    rows = [("ho  và sốt", ["ho", "và", "sốt"], ["O", "O", "B-S"]), ("a b c", ["a", "c"], ["O", "O"]), ("a b", ["a"], ["O"]), ("a", ["a"], []), ("a", ["b"], ["O"]), ("aa a", ["aa", "a"], ["O", "O"])]
    got = parsers.transcripts(spark.createDataFrame(rows, "text string, words array<string>, labels array<string>"), "train").collect()
    by = {(r.text, tuple(r.labels)): r for r in got}
    assert [tuple(s) for s in by["ho  và sốt", ("O", "O", "B-S")].spans] == [(0, 2), (4, 6), (7, 10)] and by["ho  và sốt", ("O", "O", "B-S")].problem is None
    assert by["a b c", ("O", "O")].problem == "word:1" and by["a b", ("O",)].problem == "suffix" and by["a", ()].problem == "length" and by["a", ("O",)].problem == "word:0"
    assert [tuple(s) for s in by["aa a", ("O", "O")].spans] == [(0, 2), (3, 4)]


def test_bundles(spark):
    b = {"resourceType": "Bundle", "id": "b1", "entry": [{"resource": {"resourceType": "Patient", "id": "p1"}}, {"resource": {"resourceType": "Observation", "status": "final", "code": {"text": "Na"}, "valueQuantity": {"value": 140, "unit": "mmol/L"}}}]}
    got = parsers.bundles(spark.createDataFrame([(json.dumps(b),), ('{"resourceType":"Patient"}',)], "payload string")).collect()
    assert len(got) == 1 and got[0].external_id == "b1" and got[0].group_ids == ["patient:p1"] and "Observation: Na; 140 mmol/L; final" in got[0].text


LABEL = b"""<document xmlns="urn:hl7-org:v3"><setId root="S1"/><versionNumber value="3"/><effectiveTime value="2020"/><title>Drug</title>
<component><section><title>Use</title><text>For  pain.</text></section></component>
<subject><manufacturedProduct><manufacturedProduct><code code="1-2"/><name>Aspirin</name></manufacturedProduct></manufacturedProduct></subject></document>"""


def test_product_labels(spark):
    inner = archive(**{"a.xml": LABEL})
    got = parsers.product_labels(files(spark, LABEL, archive(**{"x/in.zip": inner, "pic.jpg": b"x"}))).collect()
    assert len(got) == 1 and got[0].set_id == "S1" and got[0].text == "Drug\n\nUse\nFor pain." and [(p.name, p.ndc) for p in got[0].products] == [("Aspirin", "1-2")]


def test_case_archives(spark):
    z = archive(**{"d/train/text_files/c1.txt": "fiebre y tos", "d/train/trainX.tsv": "c1\tDIAGNOSTICO\tr50\tfiebre tos\t0 6;9 12\nc1\tDIAGNOSTICO\tr05\ttos\t0 3\nzz\tP\tx\ty\t0 1\n"})
    cases, labels = parsers.case_archives(files(spark, z))
    assert [(r.split, r.case_id, r.text) for r in cases.collect()] == [("train", "c1", "fiebre y tos")]
    assert {(r.case_id, r.code, r.valid) for r in labels.collect()} == {("c1", "r50", True), ("c1", "r05", False), ("zz", "x", False)}


def test_code_book(spark):
    x = b'<ClaML><Class code="A00" kind="category"><SuperClass code="A00-A09"/><Rubric kind="preferred"><Label>Cholera</Label></Rubric><Rubric kind="inclusion"><Label>x</Label></Rubric></Class><Class code="I"/></ClaML>'
    got = parsers.code_book(files(spark, x, archive(**{"b.xml": x}))).collect()
    assert [(r.code, r.name, r.parent, r.aliases) for r in got] == [("A00", "Cholera", "A00-A09", ["x"])]


def test_lexicon_inventory_and_gold(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("concept_id\tcanonical_name\tsemantic_type\taliases\nc1\tHo\tSYMPTOM\ta| b|a\nc2\t\tSYMPTOM\t\nc3\tX\tD\t\nc3\tY\tD\t\n")
    got = {(r.concept_id, r.canonical_name): r for r in parsers.lexicon(spark, str(tmp_path / "l.tsv")).collect()}
    assert got["c1", "Ho"].aliases == ["a", "b"] and got["c1", "Ho"].problem is None and got["c2", None].problem == "missing:canonical_name" and got["c3", "X"].problem == "duplicate_concept"
    (tmp_path / "i.jsonl").write_text('{"term_id":"t1"}\n{"term_id":"t1"}\n{"term_id":"t2"}\n')
    assert sorted(r.repeated for r in parsers.inventory(spark, str(tmp_path / "i.jsonl")).collect()) == [False, True, True]
    (tmp_path / "documents.jsonl").write_text('{"document_id":"d","text":"ho"}\n')
    (tmp_path / "gold.jsonl").write_text('{"document_id":"d","entities":[{"id":"E1","span":[0,2],"text":"ho","type":"SYMPTOM"}]}\n')
    docs, gold = parsers.gold_dataset(spark, str(tmp_path))
    assert docs.count() == 1 and [(r.start, r.end, r.type) for r in gold.collect()] == [(0, 2, "SYMPTOM")]


def test_boxed_rows(spark):
    rows = [(1, 10, 50, "A00"), (1, 10, 100, "Cholera"), (1, 11, 100, "disease"), (1, 20, 50, "A01.1"), (1, 20, 100, "Typhoid"), (2, 5, 100, "fever"), (2, 9, 50, "B00"), (2, 9, 200, "vi"), (1, 1, 100, "head")]
    got = parsers.boxed_rows(spark.createDataFrame(rows, "page int, y int, x int, word string"), (40, 60), {"en": (90, 150), "vi": (190, 250)}).orderBy("row").collect()
    assert [(r.code, r.page, r.en, r.vi) for r in got] == [("A00", 1, "Cholera disease", ""), ("A01.1", 1, "Typhoid fever", ""), ("B00", 2, "", "vi")]
