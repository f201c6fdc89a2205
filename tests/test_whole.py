"""Registered queries over all rows of their tables."""

import itertools
import random
from collections import defaultdict

from groundmill.plans import data_queries, extract_queries, registry  # noqa: F401


def put(spark, tmp_path, name, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")


def test_documents_of_all_languages_are_annotated(spark, tmp_path):
    texts = {1: ("en", "not hydrogen here"), 2: ("fr", "avec hydrogen et hydrogen"), 3: ("de", "if hydrogen"), 4: (None, "nur hydrogen da"), 5: ("es", "sin nada")}
    texts |= {k: ("es", "gas hydrogen") for k in range(10, 18)}
    put(spark, tmp_path, "documents", [(k, t, lang) for k, (lang, t) in texts.items()], "doc_id long, text string, lang string")
    got = {r.document_id: (r.entities, r.in_context) for r in registry.QUERIES["document_pipeline"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (1, 1), 4: (1, 0)} | {k: (1, 0) for k in range(10, 18)}
    rows = registry.QUERIES["cue_context"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.assertion) for r in rows) == sorted([(1, "NEGATED"), (2, "PRESENT"), (2, "PRESENT"), (3, "CONDITIONAL"), (4, "PRESENT")] + [(k, "PRESENT") for k in range(10, 18)])


def jaccard(p, k):
    """The expected Jaccard of the first ``k``, over all outcomes."""
    total = 0.0
    for right in itertools.product((0, 1), repeat=len(p)):
        chance = 1.0
        for x, y in zip(p, right, strict=True):
            chance *= x if y else 1 - x
        total += chance * sum(right[:k]) / (k + sum(right[k:]))
    return total


def test_all_customers_get_a_set(spark, tmp_path):
    g = random.Random(5)
    orders = [(o, 1 + o % 12) for o in range(40)]
    items = [(o, 100 + g.randrange(15), float(g.randrange(1, 51)), g.randrange(11) / 100) for o, _ in orders for _ in range(3)]
    put(spark, tmp_path, "orders", orders, "o_orderkey long, o_custkey long")
    put(spark, tmp_path, "lineitem", items, "l_orderkey long, l_partkey long, l_quantity double, l_discount double")
    best = defaultdict(dict)
    for o, code, n, discount in items:
        key = (code, "exact" if n > 25 else "bm25")
        one = best[dict(orders)[o]]
        one[key] = max(one.get(key, 0.0), round(discount * 8 + 0.1, 4))
    want = {}
    for c, one in best.items():
        w = {"exact": 1.0, "bm25": 0.5}
        rank = {k: 1 + sum(s == k[1] and (-y, x) < (-one[k], k[0]) for (x, s), y in one.items()) for k in one}
        fused = []
        for code in {k[0] for k in one}:
            own = [k for k in one if k[0] == code]
            p = max(one[k] for k in own)
            share = sum(w[k[1]] * one[k] / (60 + rank[k]) for k in own) / (sum(w[k[1]] for k in own) / 61)
            fused.append((-round(min(1.0, p + (1 - p) * 0.1 * share) if len(own) > 1 else p, 6), code))
        top = sorted(fused)[:5]
        e = [jaccard([-s for s, _ in top], k) for k in range(1, len(top) + 1)]
        want[c] = (round(max(e), 6), [str(x) for _, x in top[: 1 + e.index(max(e))]] if max(e) > 0.3 else [])
    got = {r.mention_id: (r.expected, [str(x) for x in r.codes]) for r in registry.QUERIES["emitted_sets"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() == set(range(1, 13))
    assert all(got[c][1] == want[c][1] and abs(got[c][0] - want[c][0]) < 2e-6 for c in want)
