import re
import zlib

import numpy as np

import corpus_pipeline as P
from groundmill.llm import registry
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = registry.table(spark, SF, "documents")
    extra = [(10_001, None), (10_002, ""), (10_003, "12 34 ..."), (10_004, "write to a.b@c.org " + "the of and to in is it with " * 3)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, "src0", 0) for i, t in extra], docs.schema)).cache()
    have = {r.doc_id: r for r in docs.collect()}
    one = P.language(spark, docs, SF).cache()
    assert one.columns == P.COLUMNS and {r.doc_id for r in one.collect()} == set(have) - {10_001, 10_002, 10_003}
    rows = [(r.doc_id, r.text) for r in one.collect()]
    kept = {i for i, _, c, _ in brute(rows, 5, 80) if i == c}
    two = P.near_duplicates(spark, one, SF).cache()
    assert two.columns == P.COLUMNS and {r.doc_id for r in two.collect()} == kept
    bench = [" ".join(re.findall(r"\w+", r.text.lower())) for r in registry.table(spark, SF, "benchmark").collect()]
    leaky = {r.doc_id for r in two.collect() if any(b in " ".join(re.findall(r"\w+", r.text.lower())) for b in bench)}
    three = P.benchmark_leaks(spark, two, SF).cache()
    assert leaky and {r.doc_id for r in three.collect()} == kept - leaky
    four = P.personal_data(spark, three, SF).cache()
    after = {r.doc_id: r for r in four.collect()}
    assert set(after) == kept - leaky and "<EMAIL>" in after[10_004].text and all(r.n_chars == len(r.text) for r in after.values())
    five = P.windows(spark, four, SF).collect()
    assert {r.doc_id for r in five} == set(after)
    pieces = {(r.doc_id, r.start): r for r in five}
    t = __import__("groundmill.llm.packing", fromlist=["x"])._tokenizer(registry.tokenizer_path()).whole
    for i in sorted(after)[:20]:
        ids = np.array([*t.encode(after[i].text, add_special_tokens=False).ids, 2], "<u4")
        p = pieces[i, 0]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[: p.length].tobytes())


def test_empty_documents(spark):
    docs = registry.table(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
