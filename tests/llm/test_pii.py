import hashlib
import re

from pyspark.sql import functions as F

from groundmill.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            v, d = m[0], re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in v.split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "", None, "no data", "mail me: a.b+c@d-e.co.uk.", "a@b.c_d@e.f", "x@y", "@@a@b.c", "é😀 z@q.org 10.0.0.1 1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.256 001.002.003.0255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 5500005555555559x", "+1 (555) 010-9999 +12 +44 20 7946 0958.", "+1+2+33333333333 5",
    "IBAN GB82 WEST 1234 5698 7654 32 and GB83WEST12345698765432", "ssn 123-45-6789, 000-12-3456, " + "x" * 40 + " 123-45-6789 alone",
    "0" * 3000, "a" * 5000, "1.2.3.4 " * 400, "a@" + "b." * 3000 + "c", "- " * 10 + "4111 1111 1111 1111 " * 3,
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.pii_report(df).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = brute(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (t or "")[:60]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(w[0] == k for w in want) for k in BASE)
        assert got[i].spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want))
    assert "iban:5:32" in got[13].spans and "iban" not in got[13].spans.replace("iban:5:32", "")
    assert got[14].spans == "ssn:4:15"


def test_redaction_and_odd_tables(spark):
    df = spark.createDataFrame([(1, "write a@b.cc or +1 555 010 9999!", 5), (1, None, 6), (None, "clean", 7)], "doc_id long, text string, pii int").drop("pii")
    rows = sorted(pii.redact(df).collect(), key=lambda r: (r.doc_id is None, r.text is None))
    assert rows[0].text == "write <EMAIL> or <PHONE>!" and rows[1].text is None and rows[2].text == "clean"
    assert pii.pii_report(df.limit(0)).count() == 0
    assert pii.pii_report(df).where(F.col("doc_id").isNull()).count() == 1


def test_main_path_is_native(spark):
    plan = pii.pii_report(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_very_many_spans(spark):
    """Two levels of sums: offsets hold across chunks, and 5,000 spans are no harder than their text."""
    texts = [" ".join(f"{i % 256}.1.2.3" for i in range(n)) for n in (127, 128, 129, 300, 5_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_report(df).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_ip == t.count(" ") + 1
        assert got[i].spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)))
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert all(clean[i] == re.sub(r"[0-9.]+", "<IP>", t) for i, t in enumerate(texts))
