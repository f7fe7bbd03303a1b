import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestrata.llm.packing import combinations, encoder, nnls_counts, pack_documents, plan_patterns

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def check(df, texts):
    """Each id in one piece, sequences gapless and of at most 1024; returns the share of padding."""
    rows = df.collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = np.array([*reference_ids(text or ""), 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for seq in sequences.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return 1 - sum(r.length for r in rows) / (1024 * len(sequences))


def test_packs_the_documents(docs):
    assert check(pack_documents(docs, PATH), {r.doc_id: r.text for r in docs.collect()}) < 0.03


@pytest.mark.parametrize("text", ["<|endoftext|> it's", "a<|endoftext|><|endoftext|>b", " <|endoftext|>  x\n<|endoftext|", "it's 12 Größe\u3000\u00a0 \U0001f600", "\x00\x1f  \t\n"])
def test_ids_are_the_librarys(text):
    assert [*encoder(PATH)(text)] == reference_ids(text)


def test_packs_awkward_rows(awkward, no_docs):
    one = awkward.dropDuplicates(["doc_id"])
    check(pack_documents(one, PATH), {r.doc_id: r.text for r in one.collect()})
    again = pack_documents(awkward, PATH)
    assert again.where("doc_id = 6").count() == 2 and again.select("sequence_id", "offset").distinct().count() == again.count()
    assert pack_documents(no_docs, PATH).count() == 0


def test_ids_are_the_tokenizers_librarys(docs):
    encode = encoder(PATH)
    rng = np.random.default_rng(1)
    odd = ["".join(chr(c) for c in rng.choice([*range(0, 0x250), 0x2003, 0x2028, 0x3042, 0x1F600, 0x0661, 0x93F, 0x301], 200)) for _ in range(200)]
    for text in [*(r.text for r in docs.limit(50).collect()), *odd, "<|endoftext|>", "'ll 'LL I've  \n\n x"]:
        assert encode(text) == reference_ids(text)


def test_least_squares_recovers_a_mixture():
    combos = combinations(64)
    x = np.zeros(len(combos))
    x[[5, 100, 300]] = 50, 20, 70
    hist = sum(np.bincount(combos[:, k], x, 64) for k in range(3))
    hist[0] = 0
    got = nnls_counts(hist, combos)
    back = sum(np.bincount(combos[:, k], got, 64) for k in range(3))
    assert (got >= 0).all() and np.abs(back[1:] - hist[1:]).max() < 1


def test_plan_uses_each_length_as_often_as_it_occurs():
    rng = np.random.default_rng(2)
    hist = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 1025), 400, False), rng.integers(1, 500, 400))}
    plan = plan_patterns(dict(hist))
    used = defaultdict(int)
    for lengths, n in plan:
        assert sum(lengths) <= 1024 and n > 0
        for v in lengths:
            used[v] += n
    assert dict(used) == hist
    total = sum(k * v for k, v in hist.items())
    assert sum(n for _, n in plan) <= 1.1 * total / 1024
