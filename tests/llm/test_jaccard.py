import random
import re
from collections import Counter, defaultdict

import pytest

from groundmill.llm.jaccard import jaccard_classes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[root(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min(least[root(i)]), links[i]) for i in range(len(rows))]


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shared = [r.choice(words) for _ in range(60)]
    rows = []
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 8, 12, 20, 40, 90, 150]))]
        if r.random() < 0.4:
            base = base + shared
        for _ in range(r.choice([1, 1, 2, 6])):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                at = r.randrange(len(x) + 1)
                if r.random() < 0.5 and len(x) > 1:
                    x.pop(at % len(x))
                else:
                    x.insert(at, r.choice(words))
            rows.append((len(rows) * 3 + 5, " ".join(x)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 100), (5, 80, 250_000)])
def test_equals_brute_force(spark, k, percent, block):
    rows = corpus(k)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_classes(df, k, percent, block=block).collect())
    assert got == sorted(brute(rows, k, percent))


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a c"), (7, "x " * 5000 + "y"), (8, "x " * 5000 + "y"), (9, "é ü ß"), (9, "é ü ß"), (None, "a b"), (10, "É ü ß")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, rep string")
    got = {(r.doc_id, r.n_shingles): r for r in jaccard_classes(df, 3, 90).collect()}
    assert got[2, 0].component_id == 2 and got[3, 0].component_id == 3 and got[1, 0].component_id == 1
    assert got[5, 1].component_id == 4 and got[6, 1].component_id == 6 and got[None, 1].component_id == 4
    assert got[8, 2].component_id == 7 and got[9, 1].component_id == 9 and got[9, 1].n_links == 1 and got[10, 1].component_id == 10
    assert jaccard_classes(df.limit(0), 3, 90).count() == 0


def test_repeated_ids(spark):
    far = " ".join(f"v{i}" for i in range(40))
    rows = [(9, "a b c d"), (9, far), (9, far), (4, "a b c d"), (12, far + " end"), (12, "q"), (15, "q"), (None, "q"), (12, far + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_classes(df, 3, 90).collect()), key=str)
    want = sorted(((i, n, c if i is not None else 12, m) for i, n, c, m in brute([(99 if i is None else i, t) for i, t in rows], 3, 90) for i in [None if i == 99 else i]), key=str)
    assert got == want
