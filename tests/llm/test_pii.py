import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.pii import KINDS, LABELS, base_spans, find, luhn, pii_report, redact, trained, viterbi

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@@..-+_%() 0123456789\né", max_size=60))
def test_patterns_equal_the_plain_expressions(text):
    assert base_spans(text) == brute(text)


def test_patterns_on_cards_and_long_runs():
    for text in ("4539 1488 0343 6467", "x4539-1488-0343-6467x", "1.2.3.4.5.6.7.8", "@a.b@c.d", "a@b@c.d.e", "000255.1.1.1"):
        assert base_spans(text) == brute(text)
    for text in ("1" * 60_000, "+1" + "(" * 60_000, "a" * 60_000 + "@", "1." * 30_000, "@" * 60_000):
        base_spans(text)


def test_report(spark, awkward, docs, no_docs):
    more = spark.createDataFrame([(100, "call (415) 555-2671 now, or é a.b@c.de; card 4845 1681 1440 7321 and 10.0.0.300")], "doc_id long, text string")
    for df in (awkward.select("doc_id", "text"), docs.select("doc_id", "text"), more):
        rows = sorted(df.collect(), key=lambda r: (r.doc_id, r.text or ""))
        got = sorted(pii_report(df).collect(), key=lambda r: r.doc_id)
        for r, g in zip(rows, got):
            base = brute(r.text or "")
            told = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
            assert g.doc_id == r.doc_id and g.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
            assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(b[0] == k for b in base) for k in KINDS]
            spans = g.spans.split(",") if g.spans else []
            assert set(told.split(",")) - {""} <= set(spans) and len(spans) == len(base) + g.n_added
    assert pii_report(no_docs).count() == 0


def test_field_adds_what_patterns_miss_and_leaves_prose_alone():
    texts = ["please call (415) 555-2671 today", "or 415-555-2671.", "in 2019 we sold 12,500 at 3.5% on 2024-01-05", "version 2.0. of 1998", "die Nummer ist 4845168114407321 gut", 'token = "681c09b8e90e7e8c9575180f595f646cf2969054" x']
    got = [[(k, t[s:e]) for k, s, e in more] for t, (_, more) in zip(texts, find(pa.array([t.encode() for t in texts]), trained()))]
    assert got == [[("phone", "(415) 555-2671")], [("phone", "415-555-2671")], [], [], [("card", "4845168114407321")], []]


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    k = len(LABELS)
    e, trans = rng.standard_normal((5, 4, k)), rng.standard_normal((k, k))
    for row, best in zip(e, viterbi(e, trans)):
        score = lambda p: trans[0, p[0]] + sum(row[t, p[t]] for t in range(4)) + sum(trans[p[t], p[t + 1]] for t in range(3)) + trans[p[-1], 0]
        assert tuple(best) == max(itertools.product(range(k), repeat=4), key=score)


def test_redaction(spark, awkward):
    df = spark.createDataFrame([(1, "mail a.b@c.de now", 17), (2, None, None), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, redact(df).collect())) == [(1, "mail [EMAIL] now", 16), (2, None, None), (3, "plain", 5)]
    assert redact(awkward).dtypes == awkward.dtypes
