import random

import numpy as np
import pyarrow as pa

from groundmill.llm import decontaminate as D


def items(seed, n=60):
    r = random.Random(seed)
    common, words = [f"c{i}" for i in range(8)], [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        size = r.randint(12, 50)
        w = [r.choice(common) if r.random() < 0.4 else r.choice(words) for _ in range(size)]
        w[size // 2] += "."
        out.append((i, " ".join(w) + "."))
    return out, common, words


def brute(index, terms, threshold):
    score = np.zeros(len(index.items))
    for t in terms:
        a, b = index.begin[t], index.begin[t + 1]
        score[index.item[a:b]] += index.weight[a:b]
    return [(i, s) for i, s in enumerate(score) if s >= threshold - 1e-6]


def test_wand_equals_brute_force():
    its, common, words = items(1)
    index = D.build(its)
    r = random.Random(2)
    for _ in range(300):
        terms = np.array(sorted(r.sample(range(len(index.terms)), r.randint(1, 80))))
        if r.random() < 0.5:
            j = r.randrange(len(its))
            own = np.unique(np.searchsorted(index.terms, next(D._words(pa.array([its[j][1]])))[2]))
            terms = np.unique(np.concatenate([terms, own[: r.randint(1, len(own))]]))
        for threshold in (0.1, 0.3, 0.55):
            got, want = sorted(D.wand(index, terms, threshold)), brute(index, terms, threshold)
            assert [g[0] for g in got] == [w[0] for w in want]
            assert np.allclose([g[1] for g in got], [w[1] for w in want])


def test_passages_equal_brute_force():
    its, common, words = items(3)
    index = D.build(its)
    r = random.Random(4)
    texts = []
    for _ in range(60):
        w = [r.choice(common + words) for _ in range(r.choice([0, 1, 5, 40, 300, 1000]))]
        if r.random() < 0.5:
            at = r.randint(0, len(w))
            w[at:at] = r.choice(its)[1].split()
        texts.append(" ".join(w))
    passage, threshold = 120, 0.4
    for lo, hi, h, rows, _ in D._words(pa.array(texts)):
        got = {(row, word, item) for row, word, item, _ in D.passages(index, h, rows, hi - lo, passage, threshold)}
        want = set()
        for i in range(hi - lo):
            x = h[rows == i]
            for word in range(0, max(1, len(x)), passage // 2):
                if word and word + passage // 2 >= len(x) and word >= len(x):
                    break
                if word and len(x) - word <= passage // 2:
                    break
                part = x[word : word + passage]
                spot = np.minimum(np.searchsorted(index.terms, part), len(index.terms) - 1)
                for item, _ in brute(index, np.unique(spot[index.terms[spot] == part]), threshold):
                    want.add((i, word, item))
        assert want <= got
        assert {(r0, i0) for r0, _, i0 in got} == {(r0, i0) for r0, _, i0 in want}


def test_leaks_found_and_clean_kept(spark):
    its, common, words = items(5)
    r = random.Random(6)
    clean = [" ".join(r.choice(common + words) for _ in range(300)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, clean[i] + " " + its[i][1].upper() + "\n" + clean[i + 1]) for i in range(20)]
    rows += [(200, None), (201, ""), (202, its[0][1]), (202, its[0][1]), (None, its[1][1]), (203, "z " * 200_000 + its[2][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*its, (900, None), (901, ""), (902, " ".join(f"long{i}" for i in range(500)))], "item_id long, text string")
    got = D.find_leaks(docs, bench).where("leak").collect()
    assert {(x.doc_id, x.item_id) for x in got} >= {(100 + i, i) for i in range(20)} | {(202, 0), (None, 1), (203, 2)}
    assert not {x.doc_id for x in got} & set(range(30)) and sum(x.doc_id == 202 and x.item_id == 0 for x in got) == 2
    assert D.find_leaks(docs.limit(0), bench).count() == 0 and D.find_leaks(docs, bench.limit(0)).count() == 0


def test_items_in_several_passes(spark, monkeypatch):
    its, _, _ = items(7)
    docs = spark.createDataFrame([(i, t) for i, t in its], "doc_id long, text string")
    monkeypatch.setattr(D, "INDEX_ITEMS", 7)
    got = D.find_leaks(docs, spark.createDataFrame(its, "item_id long, text string")).where("leak")
    assert {(i, i) for i, _ in its} <= {(r.doc_id, r.item_id) for r in got.collect()}


def test_passes_do_not_change_the_results(spark, monkeypatch):
    its, common, words = items(8)
    r, rows = random.Random(9), []
    for i, t in its:
        w = t.split()
        rows.append((i, " ".join(r.choice(common + words) for _ in range(60)) + " " + " ".join(w[: int(len(w) * r.uniform(0.4, 1.0))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*its, (900, None), (901, "?"), (902, " ".join(f"long{i}" for i in range(200)))], "item_id long, text string")
    found = lambda: sorted((x.doc_id, x.item_id, x.word, round(x.score, 6), x.question, x.answer, x.leak) for x in D.find_leaks(docs, bench).collect())
    want = found()
    monkeypatch.setattr(D, "INDEX_ITEMS", 7)
    assert found() == want and 20 < len(want)
