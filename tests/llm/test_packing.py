import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from groundmill.llm import packing
from groundmill.llm.registry import tokenizer_path

TEXTS = [
    "", None, "Hello, World! it's we'll they've 'start ''s I'M", "a1b22 333 ½ ²", "Étion dans, çouelle\tun  éonierç\n", "emoji 😀 日本語 text", "é combining é",
    "<|endoftext|> special", "İstanbul ΑΣ ὈΔΟΣ", "x" * 30000, "word " * 9000, "  nbsp\x85z", "don'td 're 'll 'd9 'm_ 'ß l'l", "\x00\x1c\x1d ctrl", "'", "''", "a'", "1's", "Ünïcödé–dash — “q”", "ǅ ﬁ ŉ",
]


def ids(text):
    import tokenizers

    return tokenizers.Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(monkeypatch):
    t = packing.Tokenizer(tokenizer_path())
    r = random.Random(1)
    alphabet = "abcDEF'  \n.,!1é'ßtsdmrevl"
    texts = [*TEXTS, *("".join(r.choice(alphabet) for _ in range(60)) for _ in range(300))]
    for _ in range(2):
        for text, got in zip(texts, t.encode(pa.array(texts, pa.string())), strict=True):
            assert got.tolist() == ids(text), repr((text or "")[:60])
    monkeypatch.setattr(packing, "CACHE", 5)
    for text, got in zip(texts[:40], t.encode(pa.array(texts[:40], pa.string())), strict=True):
        assert got.tolist() == ids(text)


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_differencing_gives_near_equal_windows(n):
    sizes = np.random.default_rng(n).integers(1, 1024, n)
    found = packing.windows(sizes, 4096)
    total = np.bincount(found, sizes)
    assert total.max() <= 4096 and len(found) == n
    if n == 400:
        assert total[total > 0].min() > 0.97 * 4096


def test_window_count_rises():
    found = packing.windows(np.array([3, 3, 3]), 5)
    assert len(set(found.tolist())) == 3


def test_round_trip(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS * 3)] + [(None, "null id", "k"), (0, TEXTS[4], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    got = packing.pack(df, tokenizer_path()).collect()
    full = {i: np.array([*ids(t), 2], "<u4") for i, t, _ in rows if i}
    seen, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        seen[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, x in full.items():
        at = 0
        for r in sorted(seen[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
            at += r.length
        assert at == len(x)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in seen[0]) == len(ids("")) + 1 + len(ids(TEXTS[4])) + 1
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


def test_groups_are_bounded_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    seen = []
    true = packing.windows
    monkeypatch.setattr(packing, "windows", lambda sizes, capacity: seen.append(len(sizes)) or true(sizes, capacity))
    df = spark.range(1500).selectExpr("if(id % 2 = 0, 7, id) as doc_id", "cast(null as string) as text")
    got = packing.pack(df, tokenizer_path()).collect()
    per = defaultdict(int)
    for r in got:
        per[r.sequence_id >> 32] += 1
    assert len(got) == 1500 and len(per) == 15 and max(per.values()) < 200  # repeated rows are dealt apart
    assert len({(r.sequence_id, r.offset) for r in got}) == 1500


def test_new_words_take_one_call(monkeypatch):
    t = packing.Tokenizer(tokenizer_path())
    calls, true = [], t.whole

    class Counted:
        pre_tokenizer, model = true.pre_tokenizer, None

        def encode(self, text, add_special_tokens):
            calls.append(text)
            return true.encode(text, add_special_tokens=add_special_tokens)

    t.whole = Counted()
    text = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}x, don't 7" for i in range(500))
    assert next(iter(t.encode(pa.array([text])))).tolist() == ids(text) and len(calls) == 1
