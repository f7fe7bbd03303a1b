import hashlib
import re

import pytest

from lodestrata.llm.decontaminate import contamination, contamination_report, decontaminate


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if got := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out)


ITEMS = [(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, "..."), (4, "One, Two"), (4, "One, Two"), (10, "jumps over the lazy dog the quick brown fox jumps"), (11, "größe àé")]


@pytest.mark.parametrize("chunk", [1_000_000, 2])
def test_report_of_awkward_rows(spark, awkward, no_docs, chunk):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    found = contamination(awkward, bench, chunk_windows=chunk)
    got = sorted((r.row.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found.collect())
    assert got == [x[:4] for x in brute(rows, ITEMS)]
    assert contamination(no_docs, bench, chunk_windows=chunk).count() == 0


def test_report_equals_brute_force(docs, benchmark_rows):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in benchmark_rows.collect()])
    assert any(x[3] for x in want)
    assert sorted(map(tuple, contamination_report(docs, benchmark_rows).collect())) == want
    assert contamination_report(docs, benchmark_rows.limit(0)).where("n_hit > 0").count() == 0


def test_cuts_leave_no_window(docs, benchmark_rows):
    left = decontaminate(docs, benchmark_rows)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    report = {r.doc_id: r for r in contamination_report(docs, benchmark_rows).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = left.collect()
    assert {r.doc_id for r in rows} == {i for i, r in report.items() if not r.contaminated}
    for r in rows:
        assert r.n_chars == len(r.text)
        assert (r.text == texts[r.doc_id]) == (report[r.doc_id].n_hit == 0)
        assert len(words(r.text)) == report[r.doc_id].n_words - report[r.doc_id].n_hit
