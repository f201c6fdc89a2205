"""Operators that SQL can't say, held against plain versions of themselves."""

import itertools
import math
import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from groundmill.operators import assertions, datasets, gates, graph, linking, mining, offsets, proposals, retrieval, terminology
from groundmill.plans import span_queries


def names(n, seed=1):
    r = random.Random(seed)
    return sorted({" ".join(r.choice(["iron", "steel", "ring", "rings", "bolt", "bo", "red", "redder", "a", "x1"]) for _ in range(r.choice([1, 2, 3]))) for _ in range(n)})


def test_fuzzy(spark):
    keys = names(40)
    grams = lambda t: {f" {t} "[i : i + 3] for i in range(len(t))}

    def score(a, b):
        x, y = set(a.split()), set(b.split())
        return round(max(SequenceMatcher(a=a, b=b).ratio(), len(x & y) / len(x | y)), 6)

    want = {}
    for q in keys:
        hits = sorted((-score(q, k), k) for k in keys if grams(q) & grams(k) and score(q, k) >= 0.72)
        want |= {(q, k): -s for s, k in hits[:5]}
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = retrieval.fuzzy(df.withColumn("mention_id", F.col("key")), df.withColumn("concept_id", F.col("key")), 5).collect()
    assert {(r.mention_id, r.concept_id): r.score for r in got} == want and ("a", "a") in want


def test_ngram_cosine(spark):
    keys = [k for k in names(30, 2) if len(k) >= 5]
    grams = {k: Counter(k[i : i + n] for n in (3, 4, 5) for i in range(len(k) - n + 1)) for k in keys}
    df = Counter(g for c in grams.values() for g in c)
    w = {k: {g: n * math.log(1 + len(keys) / (1 + df[g])) for g, n in c.items()} for k, c in grams.items()}
    size = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in w.items()}
    d = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(r.mention_id, r.concept_id): r.score for r in retrieval.ngram_cosine(d.withColumn("mention_id", F.col("key")), d.withColumn("concept_id", F.col("key")), 100).collect()}
    for a in keys:
        for b in keys:
            s = sum(x * w[b].get(g, 0) for g, x in w[a].items()) / (size[a] * size[b])
            assert abs(got.get((a, b), 0) - (s if s >= 0.12 else 0)) < 2e-6


def test_simhash_links(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(12):
        t = [r.choice(words) for _ in range(120)]
        texts += [" ".join(t), " ".join(t[:-1] + ["end"]), " ".join(t)]
    bits = [mining.simhash64(t) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 3}
    parent = list(range(len(texts)))
    got = mining.simhash_pairs(spark.createDataFrame(list(enumerate(texts)), "doc int, text string"), "doc", "text").collect()
    assert {(max(x.a, x.b), min(x.a, x.b)) for x in got} <= near and all((bits[x.a] ^ bits[x.b]).bit_count() == x.distance for x in got)

    def root(p, x):
        while p[x] != x:
            x = p[x]
        return x

    other = list(parent)
    for i, j in near:
        parent[root(parent, i)] = root(parent, j)
    for x in got:
        other[root(other, x.a)] = root(other, x.b)
    same = lambda p: {(i, j) for i in range(len(texts)) for j in range(i) if root(p, i) == root(p, j)}
    assert same(parent) == same(other) and near


def test_emission(spark):
    r = random.Random(4)
    rows = [(m, f"c{j}", round(r.random(), 3)) for m in range(30) for j in range(r.choice([1, 2, 4, 7]))]
    got = {x.mention_id: list(x.asDict().values())[1] for x in linking.emission(spark.createDataFrame(rows, "mention_id int, code string, score double"), 0.3).collect()}
    for m in range(30):
        c = sorted(((-s, k) for i, k, s in rows if i == m))[:5]
        p = [-s for s, _ in c]
        value = []
        for k in range(1, len(p) + 1):
            total = 0.0
            for true in itertools.product([0, 1], repeat=len(p)):
                chance = math.prod(x if t else 1 - x for x, t in zip(p, true))
                hit = sum(true[:k])
                total += chance * hit / (k + sum(true[k:]))
            value.append(total)
        best = max(value)
        want = [k for _, k in c[: value.index(best) + 1]] if best > 0.3 else []
        near = sorted(value)[-2:]
        if len(near) < 2 or near[1] - near[0] > 1e-9:
            assert got[m] == want


def test_span_decisions(spark):
    r = random.Random(5)
    rows = [(d, s, s + r.randrange(1, 9), r.choice(["A", "B", None]), r.choice("xyz"), round(0.3 + 0.6 * r.random(), 3), r.random() < 0.2, r.choice([0, 0, 1])) for d in range(12) for s in r.sample(range(30), 9)]
    df = spark.createDataFrame(rows, "doc int, start int, end int, type string, source string, score double, atomic boolean, nested int")
    got = proposals.resolve(df, "doc").collect()
    merged = defaultdict(list)
    for d, s, e, t, src, sc, a, n in rows:
        if t:
            merged[d, s, e, t].append((src, sc, a, n))
    assert sum(x.decision == "unresolved_type" for x in got) == len({x[:3] + (x[5],) for x in rows if x[3] is None})
    for d in range(12):
        c = {}
        for (dd, s, e, t), v in merged.items():
            if dd == d:
                p = max(x[1] for x in v)
                c[s, e, t] = (math.log(p / (1 - p)) + 0.25 * (len({x[0] for x in v}) - 1) + 1.5 * any(x[2] for x in v) + 2.5 * max(x[3] for x in v), any(x[2] for x in v))
        inner = {k for k, (_, a) in c.items() if not a and any(b and o != k and o[2] == k[2] and o[0] <= k[0] and k[1] <= o[1] for o, (_, b) in c.items())}
        free = [k for k, (u, _) in c.items() if k not in inner and u > 0]
        best = 0.0
        for n in range(len(free) + 1):
            for some in itertools.combinations(free, n):
                if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(some, 2)):
                    best = max(best, sum(c[k][0] for k in some))
        chosen = [(x.start, x.end, x.type) for x in got if x.doc == d and x.decision == "selected"]
        assert all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(chosen, 2))
        assert sum(c[k][0] for k in chosen) == pytest.approx(best, abs=1e-6)
        assert {(x.start, x.end, x.type) for x in got if x.doc == d and x.decision == "contained_exactly"} == inner


def test_offset_maps(spark):
    texts = ["  a  b\t\nc ", "", " ", None, "Ｆｕｌｌ ﬁ width—ok", "é  Đường uống"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", "t", offsets.collapse_whitespace(F.col("t")).alias("m"), offsets.normalize_with_offsets(F.col("t"), True).alias("k")).withColumn("bad", offsets.contract_issues(F.col("m"), F.col("t"))).collect()
    for x in rows:
        if x.t is not None:
            assert x.m.norm == " ".join(x.t.split()) and x.bad == []
            assert all(x.t[p] == c or (c == " " and x.t[p].isspace()) for c, p in zip(x.m.norm, x.m.map)) and len(x.k.norm) == len(x.k.map)
    assert rows[4].k.norm == "full fi width ok" and rows[5].k.norm == "e duong uong" and rows[4].k.map[5:7] == [5, 5]
    span = offsets.original_span(F.col("m"), F.lit(2), F.lit(5))
    got = df.select("i", offsets.collapse_whitespace(F.col("t")).alias("m")).select("i", span.alias("s")).collect()
    assert (got[0].s.start, got[0].s.end) == (5, 9) and got[1].s is None


SAID = [
    ("Không đau ngực, sốt, nhưng ho nhiều.", "ho", "PRESENT"), ("Không đau ngực, sốt.", "sốt", "NEGATED"), ("không loại trừ viêm phổi", "viêm phổi", "PRESENT"),
    ("mẹ bị tiểu đường", "tiểu đường", "FAMILY"), ("mẹ đưa vào viện vì sốt", "sốt", "PRESENT"), ("không ho; sốt cao", "sốt", "PRESENT"), ("tiền sử hen", "hen", "HISTORICAL"),
    ("không ho, chẩn đoán viêm phổi", "viêm phổi", "PRESENT"), ("viêm phổi đã loại trừ", "viêm phổi", "NEGATED"),
]


def test_assertion_scopes(spark):
    cues = spark.createDataFrame([
        ("n", "không", "NEGATED", "left", 10, 60, None, None), ("r", "đã loại trừ", "NEGATED", "right", 10, 20, None, None), ("f", "mẹ", "FAMILY", "left", 20, 60, None, None),
        ("h", "tiền sử", "HISTORICAL", "left", 5, 40, None, None),
    ], span_queries.CUE_TYPE)
    rows = [(i, "DISEASE", t, t.index(m), t.index(m) + len(m), None) for i, (t, m, _) in enumerate(SAID)]
    m = spark.createDataFrame(rows, "id int, entity_type string, sentence string, start int, end int, section string")
    got = assertions.classify(m, cues)
    assert {r.id: r.assertion for r in got.collect()} == {i: s for i, (_, _, s) in enumerate(SAID)}
    nodes, edges = assertions.context_graph(m, got, cues)
    assert {(e.head, e.tail) for e in edges.collect()} >= {("modifier:f", "mention:3"), ("modifier:h", "mention:6")} and nodes.where("kind = 'modifier'").count() == 4
    f = {r.id: r.features for r in assertions.features(m, got).collect()}
    assert f[3]["status=FAMILY"] == 1.0 and f[3]["before=bị"] == 1.0


def test_closure_of_cycles_and_depth(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (1, 2)], "child int, parent int")
    got = {(r.node, r.ancestor): r.distance for r in graph.ancestors(e).collect()}
    assert got == {(1, 2): 1, (2, 3): 1, (3, 1): 1, (4, 1): 1, (1, 3): 2, (2, 1): 2, (3, 2): 2, (4, 2): 2, (4, 3): 3}
    assert {(r.node, r.ancestor): r.path for r in graph.shortest_paths(e).collect()}[4, 3] == [4, 1, 2, 3]
    assert {(r.node, r.ancestor) for r in graph.ancestors(e, 1).collect()} == {k for k, v in got.items() if v == 1}


def test_lists_labs_and_growth(spark):
    text = "Home:\n1. aspirin 81 mg po daily for pain\n2) metformin\n- \nLabs\nNa 140 mmol/l, K: 4.1\nImaging:\nview 2 normal"
    df = spark.createDataFrame([(1, text)], "doc int, text string")
    items = [(r.item, text[r.start : r.end], r.indication_start and text[r.indication_start : r.indication_end]) for r in proposals.list_items(df, "doc", "text").orderBy("item").collect()]
    assert items == [(1, "aspirin 81 mg po daily", "pain"), (2, "metformin", None)]
    pairs = {(text[r.start : r.end], text[r.result_start : r.result_end], r.in_section) for r in proposals.lab_pairs(df, "doc", "text").collect()}
    assert pairs == {("Na", "140 mmol/l", True), ("K", "4.1", True)}
    at = text.index("aspirin")
    grown = proposals.grow_mentions(df, spark.createDataFrame([(1, at, at + 7)], "doc int, start int, end int"), "doc", "text").first()
    assert text[grown.start : grown.full_end] == "aspirin 81 mg po daily" and [c.kind for c in grown.components] == ["administered_dose", "route", "frequency"]
    more = proposals.expand(df, spark.createDataFrame([(1, text.index("pain"), text.index("pain") + 4, 0.7)], "doc int, start int, end int, score double"), "doc", "text", r"for\s", r"\s\d\)").first()
    assert (text[more.start : more.end].startswith("for pain"), round(more.score, 2)) == (True, 0.74)


def test_logistic(spark):
    r = random.Random(6)
    rows = [({"a": 1.0} if y else {"b": 1.0, "c": r.random()}, y, 1.0) for y in [r.randrange(2) for _ in range(80)]]
    w = datasets.fit_sparse_logistic(spark.createDataFrame(rows, "features map<string,double>, label int, weight double"))
    assert w["a"] > 1 > 0 > w["b"]
    with pytest.raises(ValueError):
        datasets.fit_sparse_logistic(spark.createDataFrame(rows, "features map<string,double>, label int, weight double").where("label = 1"))


def test_indexes_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "norm string, concept_id int")
    root = terminology.write_index({"aliases": (df, ["norm"])}, str(tmp_path))
    again = terminology.write_index({"aliases": (df.orderBy("norm"), ["norm"])}, str(tmp_path))
    assert root == again and [x.norm for x in spark.read.parquet(root + "/aliases").collect()] in (["a", "b"], ["b", "a"])
    assert terminology.write_index({"aliases": (df.limit(1), ["norm"])}, str(tmp_path)) != root


def test_gates_raise_and_store(spark):
    with pytest.raises(ValueError, match="duplicate"):
        gates.require_none(spark.createDataFrame([("duplicate:1",)], "issue string"), "corpus")
    gates.require_none(spark.createDataFrame([], "issue string"), "corpus")
    c = F.col
    df = spark.createDataFrame([("local_only", "dua", "s3://x", False), ("immutable", "open", "file:///x", False)], "r string, a string, u string, e boolean")
    assert [x[0] for x in df.select(gates.storage_reasons(c("r"), c("a"), c("u"), c("e"))).collect()] == [["local_only_source_requires_local_store", "restricted_source_requires_encryption_at_rest"], []]
