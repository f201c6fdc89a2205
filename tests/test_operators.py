"""Operators on small hand-made tables."""

import itertools
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundmill.functions import text as T
from groundmill.operators import context, extract, graph, linking, mining, relations, retrieval, segment
from groundmill.sources import readers, writers
from groundmill.streaming import windows


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def test_keys(spark):
    df = spark.createDataFrame([("  Đái  THÁO (đường) 5-10 mg/ml™",), (None,), ("ﬁn",)], "x string")
    got = [r[0] for r in df.select(T.normalize_for_match(F.col("x"))).collect()]
    assert got == ["đái tháo đường 5-10 mg/mltm", None, "fin"]
    assert [r[0] for r in df.select(T.toneless(F.col("x"))).collect()][0].startswith("  Dai  THAO (duong)")


@pytest.mark.parametrize(("value", "want"), [("1234-5678-90", "01234567890"), ("12345-678-90", "12345067890"), ("12345-6789-0", "12345678900"), ("1-2-3", None), (None, None)])
def test_ndc(spark, value, want):
    assert one(spark, value).select(T.ndc11(F.col("x"))).first()[0] == want


def test_icd_chapter(spark):
    df = spark.createDataFrame([("A00.1",), ("e11",), ("Z99",), ("X",)], "x string")
    assert [r[0] for r in df.select(T.icd10_chapter(F.col("x"))).collect()] == ["I", "IV", "XXI", None]


def test_token_edits_and_jaccard(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    rows = df.select(T.token_edit_distance(F.col("a"), F.col("b")), T.set_jaccard(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(2, 0.4), (0, 1.0), (1, 0.0)]


def test_sections_and_parents(spark):
    text = "intro\nHistory: none\n1. Drugs\naspirin\nDrugsale\nplan\nx"
    rules = spark.createDataFrame([("history", "h"), ("drugs", "d"), ("plan", "p"), ("drug", "q")], "alias string, category string")
    df = spark.createDataFrame([(1, text), (2, "none here")], "doc_id int, text string")
    s = segment.sections(df, "doc_id", "text", rules).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.title, text[r.start : r.end] if r.doc_id == 1 else None) for r in s] == [(1, "history", "\n"), (1, "drugs", "\naspirin\nDrugsale\n"), (1, "plan", "\nx"), (2, "Document", None)]
    heads = spark.createDataFrame([(1, 0, "A", "p"), (1, 5, "B", "c"), (1, 9, "C", "p"), (1, 12, "D", "c")], "d int, s int, t string, c string")
    assert [r.parent for r in segment.nearest_parent(heads, "d", "s", "t", "c", ["p"]).orderBy("s").collect()] == [None, "A", "A", "C"]


def test_dictionary_matcher(spark):
    aliases = spark.createDataFrame([("c1", "đái tháo đường"), ("c2", "đường"), ("c3", "mg"), ("c4", "HIV")], "concept_id string, alias string")
    text = "😀 Dai thao duong; ĐÁI THÁO ĐƯỜNG, 5mg mgX HIVs đườngling"
    got = {(r.concept_id, text[r.start : r.end], r.exact) for r in extract.dictionary_matches(spark.createDataFrame([(1, text), (2, None)], "d int, t string"), aliases, "d", "t").collect()}
    assert ("c1", "Dai thao duong", False) in got and ("c1", "ĐÁI THÁO ĐƯỜNG", True) in got and ("c2", "ĐƯỜNG", True) in got
    assert ("c3", "mg", True) in got and ("c4", "HIV", True) not in got and sum(x[0] == "c2" for x in got) == 1


def test_schedule_and_assignment():
    r = np.random.default_rng(0)
    for _ in range(60):
        a, b = r.integers(1, 5, 2)
        w = r.integers(0, 9, (a, b)).astype(float)
        n = max(a, b)
        assert sum(w[i, j] for i, j in extract.best_assignment(w)) == max(sum(w[i, p[i]] for i in range(a) if p[i] < b) for p in itertools.permutations(range(n)))
        s = [(int(x), int(x + y), float(z)) for x, y, z in zip(r.integers(0, 12, 6), r.integers(1, 6, 6), r.integers(1, 9, 6), strict=True)]
        free = lambda c, s=s: all(s[i][1] <= s[j][0] or s[j][1] <= s[i][0] for i, j in itertools.combinations(c, 2))
        kept = extract.schedule(s)
        assert free(kept) and sum(s[i][2] for i in kept) == max(sum(s[i][2] for i in c) for m in range(7) for c in itertools.combinations(range(6), m) if free(c))


def test_context(spark):
    cues = spark.createDataFrame([("n", "no", "NEGATED", "left", 3, 30), ("h", "history", "HISTORICAL", "bidirectional", 1, 50), ("p", "likely", "POSSIBLE", "right", 2, 20)], "rule_id string, cue string, assertion string, scope string, priority int, most int")
    clauses = [(1, "No fever and history"), (2, "fever likely"), (3, "fever no"), (4, "nothing, fever")]
    c = spark.createDataFrame(clauses, "k int, v string")
    e = spark.createDataFrame([(k, "e", v.lower().index("fever"), v.lower().index("fever") + 5) for k, v in clauses], "k int, id string, start int, end int")
    assert [r.assertion for r in context.classify(e, c, cues, ["k"], "v").orderBy("k").collect()] == ["NEGATED", "POSSIBLE", "PRESENT", "PRESENT"]


def test_abbreviations(spark):
    df = spark.createDataFrame([(1, "He has chronic kidney disease (CKD) and (see below) magnetic resonance imaging (MRI)."), (2, "acute renal failure (ARF)")], "d int, t string")
    got = {(r.abbreviation, r.expansion) for r in extract.abbreviations(df, "d", "t").collect()}
    assert got == {("CKD", "chronic kidney disease"), ("MRI", "magnetic resonance imaging"), ("ARF", "acute renal failure")}


def test_bio_and_greedy(spark):
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(["B-A", "I-A", "O", "I-B", "B-B", "S-C", "I-C"])], "d int, i int, l string")
    assert sorted((r.type, r.first, r.last) for r in extract.decode_bio(t, "d", "i", "l").collect()) == [("A", 0, 1), ("B", 3, 3), ("B", 4, 4), ("C", 5, 5), ("C", 6, 6)]
    g = spark.createDataFrame([(1, 0, 10, "A"), (1, 8, 12, "A")], "d int, start int, end int, type string")
    p = spark.createDataFrame([(1, 0, 9, "A"), (1, 9, 11, "A"), (1, 0, 10, "B")], "d int, start int, end int, type string")
    assert sorted((r.gs, r.ps) for r in extract.greedy_overlap(g, p, "d").collect()) == [(0, 0), (8, 9)]


def test_fusion_and_assignment_margin(spark):
    c = spark.createDataFrame([("m", "x", "exact", 1.0), ("m", "x", "bm25", 0.4), ("m", "y", "bm25", 0.6), ("m", "z", "unknown", 0.3)], "mention_id string, code string, source string, score double")
    got = {r.code: r for r in retrieval.fuse(c).collect()}
    assert got["x"].score == 1.0 and got["x"].primary == "exact" and got["y"].score == 0.6 and got["z"].sources == 1
    for gap, want in ((0.05, True), (0.049, False)):
        r = spark.createDataFrame([("m", "a", 0.8, 1), ("m", "b", 0.8 - gap, 2)], "mention_id string, code string, score double, rank int")
        assert linking.assign(linking.qualify(r)).first().assigned is want


def test_expected_jaccard():
    p = [0.9, 0.5, 0.2]
    want = []
    for k in (1, 2, 3):
        total = 0.0
        for bits in itertools.product((0, 1), repeat=3):
            w = np.prod([p[i] if b else 1 - p[i] for i, b in enumerate(bits)])
            gold = {i for i, b in enumerate(bits) if b}
            total += w * len(gold & set(range(k))) / len(gold | set(range(k)))
        want.append(total)
    assert linking.expected_jaccard(p) == pytest.approx(want)


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "d")], "child string, parent string")
    got = {(r.node, r.ancestor): r.distance for r in graph.ancestors(e).collect()}
    assert got["d", "c"] == 3 and got["a", "c"] == 2 and ("a", "a") not in got
    assert {(r.node, r.ancestor): list(r.path) for r in graph.shortest_paths(e).collect()}["d", "b"] == ["d", "a", "b"]


def test_simhash_threshold(spark):
    base = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, base), (2, base.upper()), (3, base.replace("w7 ", "w7 x ")), (4, " ".join(f"v{i}" for i in range(200))), (5, None)], "d int, t string")
    got = {(r.a, r.b): r.distance for r in mining.simhash_pairs(df, "d", "t").collect()}
    want = bin(mining.simhash64(base) ^ mining.simhash64(base.replace("w7 ", "w7 x "))).count("1")
    assert got[1, 2] == 0 and (got.get((1, 3)) == want if want <= 3 else (1, 3) not in got) and not any(4 in k for k in got)


def test_nearest_two_sided(spark):
    t = spark.createDataFrame([("d", 1, 10), ("d", 2, 50)], "d string, id int, at int")
    o = spark.createDataFrame([("d", 11, 4), ("d", 12, 16), ("d", 13, 70)], "d string, id int, at int")
    got = {r.t_id: (r.o_id, r.distance) for r in relations.nearest(t, o, ["d"], "at", "id", "id", 20).collect()}
    assert got == {1: (11, 6), 2: (13, 20)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\r\ntwo".encode())
    assert readers.whole_texts(spark, str(tmp_path / "a.txt")).first().text == "one\r\ntwo"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/1.txt", "eins")
        z.writestr("x/1.ann", "T1\tDRUG 0 4\teins\nR1\tx\nT2\tDRUG 0 2;2 4\tei ns")
    assert [(r.member, r.text) for r in readers.archives(spark, str(tmp_path / "z.zip")).collect()] == [("x/1.txt", "eins")]
    b = readers.brat(spark.createDataFrame([("T1\tDRUG 0 4\teins\nR1\tx\nT2\tD 0 2;2 4\tei xx", "eins")], "payload string, text string")).orderBy("id").collect()
    assert [(r.id, r.type, r.valid, len(r.segments)) for r in b] == [("T1", "DRUG", True, 1), ("T2", "D", False, 2)]
    (tmp_path / "c.jsonl").write_text(json.dumps({"concept_id": "c", "canonical_name": "N", "aliases": ["x", "bad"], "blocked_aliases": ["bad"], "parents": ["p"], "parent_code": "q"}) + "\n")
    c = readers.concepts(spark, str(tmp_path / "c.jsonl"))
    assert c.first().parents == ["p", "q"] and {r.alias for r in readers.alias_table(c).collect()} == {"N", "x"}
    (tmp_path / "g.json").write_text(json.dumps({"graphs": [{"nodes": [{"id": "a", "lbl": "A"}, {"id": "b", "meta": {"deprecated": True}}, {"id": "c"}], "edges": [{"sub": "a", "pred": "is_a", "obj": "c"}, {"sub": "a", "pred": "is_a", "obj": "b"}, {"sub": "a", "pred": "x", "obj": "c"}]}]}))
    n, e = readers.obo_graph(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in graph.active_edges(n, e).collect()] == [("a", "c")]
    x = readers.xml_text(spark.createDataFrame([("<a><title>T 1</title><p>some  text</p></a>",)], "x string"), "x", ["title", "p"]).first()
    assert x.rendered == "T 1\nsome text" and x.rendered[x.blocks[1]["start"] : x.blocks[1]["end"]] == "some text"
    f = readers.rendered_fields(spark.createDataFrame([("a", None, "ccc")], "f1 string, f2 string, f3 string"), ["f1", "f2", "f3"]).first()
    assert f.rendered == "a\nccc" and [(b["field"], f.rendered[b["start"] : b["end"]]) for b in f.blocks] == [("f1", "a"), ("f3", "ccc")]
    df = spark.range(100).selectExpr("id", "concat('t', id) AS t")
    assert writers.digest(df) == writers.digest(df.repartition(7)) != writers.digest(df.where("id > 0"))
    assert writers.publish(df, str(tmp_path / "snap"), "id") and not writers.publish(df.repartition(3), str(tmp_path / "snap"), "id")
    with pytest.raises(ValueError, match="another snapshot"):
        writers.publish(df.where("id > 0"), str(tmp_path / "snap"), "id")


def test_stream_windows(spark, tmp_path):
    spark.sql("SELECT timestamp '2024-01-01 00:00:10' AS ts, 'a' AS k, 2.0D AS v UNION ALL SELECT timestamp '2024-01-01 00:06:00', 'a', 3.0D").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = windows.windowed_counts(s, "ts", ["k"], "5 minutes", "1 minute", "v").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.n, r.total) for r in spark.table("counts").collect()) == [(1, 2.0), (1, 3.0)]
