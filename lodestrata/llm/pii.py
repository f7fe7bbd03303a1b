"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field labels white-space tokens; its features are word shapes, digit counts and
the neighbours' shapes. It is trained on a small labelled table of made-up sentences
(labelled_table) and decoded by Viterbi, tokens of all texts of a batch at once. Only
tokens with a digit or an @ may have a label other than O, so a text falls apart into
runs of such tokens between forced O's, and decoding the runs decodes the text.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import map_texts, packed, unpacked, utf8
from lodestrata.llm.textkernel import NOT_SPACE, buffer, spans

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find, leftmost and without overlap in each kind; matches that fail their check are dropped."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):  # the local part is the run before the @
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def labelled_table() -> list[tuple[list[str], list[str]]]:
    """The training sentences: (tokens, labels), made up from templates with a fixed seed."""
    rng = np.random.default_rng(11)
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    w = lambda: "".join(rng.choice(list("abcdefghilmnoprstuväéñ"), int(rng.integers(2, 11))))
    hexed = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
    made = {
        "phone": [lambda: f"+1 ({n(3)}) {n(3)}-{n(4)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"+{n(2)} {n(3)} {n(7)}", lambda: f"{n(3)}.{n(3)}.{n(4)}", lambda: f"+{n(2)} {n(2)} {n(4)} {n(4)}"],
        "card": [lambda: n(16), lambda: f"{n(4)} {n(4)} {n(4)} {n(4)}", lambda: "-".join(n(4) for _ in range(4)), lambda: n(15)],
        "ip": [lambda: ".".join(str(v) for v in rng.integers(0, 256, 4))],
        "email": [lambda: f"{w()}.{n(2)}@{w()}.example.com", lambda: f"{w()}@{w()}.org", lambda: f"{w()}_{w()}@{w()}"],
    }
    other = [lambda: n(4), lambda: n(2), lambda: n(5), lambda: f"{n(1)}.{n(1)}.", lambda: f"{n(2)}.{n(2)}.{n(4)}", lambda: f"{n(4)}-{n(2)}-{n(2)}", lambda: f'"{hexed(40)}"', lambda: hexed(12), lambda: f"{n(3)},{n(3)}", lambda: f"{n(1)}{w()}", lambda: f"@{w()}", lambda: f"{n(2)}:{n(2)}", lambda: f"v{n(1)}.{n(2)}", lambda: n(8), lambda: f"{n(3)} {n(3)}", lambda: f"({n(4)})", lambda: n(24), lambda: f"{n(2)}%"]
    ends = ["", "", "", ".", ",", "%%%", "***", "!!", ";"]
    table = []
    for i in range(420):
        tokens, labels = [w() for _ in range(int(rng.integers(1, 4)))], []
        labels = ["O"] * len(tokens)
        for _ in range(int(rng.integers(1, 3))):
            if i % 2:
                kind = str(rng.choice(KINDS))
                parts = (made[kind][int(rng.integers(len(made[kind])))]() + str(rng.choice(ends))).split()
                tags = [f"B-{kind}"] + [f"I-{kind}"] * (len(parts) - 1)
            else:
                parts = (other[int(rng.integers(len(other)))]() + str(rng.choice(ends))).split()
                tags = ["O"] * len(parts)
            between = [w() for _ in range(int(rng.integers(1, 3)))]
            tokens += parts + between
            labels += tags + ["O"] * len(between)
        table.append((tokens, labels))
    return table


def may_label(token: str) -> bool:
    return any("0" <= c <= "9" or c == "@" for c in token)


def _shape(token: str) -> str:
    s = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: "d" + (str(len(m[0])) if len(m[0]) < 5 else "5" if len(m[0]) < 9 else "9" if len(m[0]) < 13 else "13" if len(m[0]) < 20 else "20"), token.strip(".,;:!?*%&$#\"'")))
    return s if len(s) <= 24 else "long:" + "".join(sorted(set(s)))


def features(before: str, token: str, after: str) -> list[str]:
    digits = len(_digits(token))
    size = next(str(b) for b in (0, 1, 2, 3, 4, 6, 8, 10, 12, 19, 10**9) if digits <= b)
    shape, was, comes = _shape(token), _shape(before) if may_label(before) else "-", _shape(after) if may_label(after) else "-"
    return ["1", "s=" + shape, "n=" + size, f"at={'@' in token}", f"dots={min(4, token.count('.'))}", f"plus={token[:1] == '+'}", "p=" + was, "f=" + comes, f"sp={shape}|{was}", f"sf={shape}|{comes}", f"kinds={''.join(sorted(set(re.sub(r'[^a@().+d-]', '', re.sub('[0-9]', '', shape)))))}"]


class Field:
    """A linear-chain conditional random field."""

    def __init__(self, index: dict[str, int], w: np.ndarray, trans: np.ndarray):
        self.index, self.w, self.trans = index, w, trans

    def emissions(self, before: str, token: str, after: str) -> np.ndarray:
        if not may_label(token):
            out = np.full(len(LABELS), -1e9)
            out[0] = 0
            return out
        return self.w[[self.index[f] for f in features(before, token, after) if f in self.index]].sum(axis=0)


def _scan(e: np.ndarray, trans: np.ndarray):
    """Log forward and backward sums of one sentence."""
    lse = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, len(e)):
        a[t] = e[t] + lse(a[t - 1][:, None] + trans, 0)
    for t in range(len(e) - 2, -1, -1):
        b[t] = lse(trans + (e[t + 1] + b[t + 1])[None, :], 1)
    return a, b, lse(a[-1], 0)


@lru_cache(1)
def trained(rounds: int = 40, l2: float = 0.05) -> Field:
    """The field that fits labelled_table() by AdaGrad on the penalised likelihood; every run gives the same."""
    table = [(t, [LABELS.index(x) for x in y]) for t, y in labelled_table()]
    index: dict[str, int] = {}
    rows = []
    for tokens, _ in table:
        padded = ["", *tokens, ""]
        rows.append([[index.setdefault(f, len(index)) for f in features(*padded[i : i + 3])] if may_label(t) else None for i, t in enumerate(tokens)])
    k = len(LABELS)
    w, trans = np.zeros((len(index), k)), np.zeros((k, k))
    for i, x in enumerate(LABELS):  # inside follows its own kind alone
        for j, y in enumerate(LABELS):
            if y[0] == "I" and x[2:] != y[2:]:
                trans[i, j] = -1e9
    free = trans > -1e8
    gw, gt = np.full(w.shape, 1e-2), np.full(trans.shape, 1e-2)
    forced = np.full(k, -1e9)
    forced[0] = 0
    order = np.random.default_rng(3)
    for _ in range(rounds):
        for s in order.permutation(len(table)):
            y, feats = table[s][1], rows[s]
            e = np.stack([w[f].sum(axis=0) if f is not None else forced for f in feats])
            a, b, z = _scan(e, trans)
            p = np.exp(a + b - z)
            d = np.zeros_like(trans)
            for t in range(1, len(e)):
                d += np.exp(np.minimum(0, a[t - 1][:, None] + trans + (e[t] + b[t])[None, :] - z))
                d[y[t - 1], y[t]] -= 1
            d = np.where(free, d + l2 * trans / len(table) * free, 0)
            gt += d * d
            trans = np.where(free, trans - 0.2 * d / np.sqrt(gt), trans)
            for t, f in enumerate(feats):
                if f is not None:
                    g = p[t].copy()
                    g[y[t]] -= 1
                    g = g + l2 * w[f] / len(table)
                    gw[f] += g * g
                    w[f] -= 0.2 * g / np.sqrt(gw[f])
    return Field(index, w, trans)


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels of a batch of runs of one length, each between two O's: e is (runs, tokens, labels)."""
    score = e[:, 0] + trans[0]
    back = np.zeros(e.shape, np.int8)
    for t in range(1, e.shape[1]):
        both = score[:, :, None] + trans[None]
        back[:, t] = both.argmax(axis=1)
        score = both.max(axis=1) + e[:, t]
    best = np.zeros(e.shape[:2], np.int64)
    best[:, -1] = (score + trans[:, 0]).argmax(axis=1)
    for t in range(e.shape[1] - 1, 0, -1):
        best[:, t - 1] = back[np.arange(len(e)), t, best[:, t]]
    return best


#: A run longer than this is decoded by itself, in parts of this many tokens.
RUN = 512


def viterbi_parts(parts, trans: np.ndarray) -> np.ndarray:
    """The best labels of one run between two O's, whose emissions come in parts.

    Scores are carried over from part to part. Wherever all labels' best paths have
    come from one label, what lies before it is settled and its back pointers go.
    """
    score = np.where(np.arange(len(trans)) == 0, 0.0, -np.inf)
    back: list[np.ndarray] = []
    settled: list[int] = []

    def follow(label: int, upto: int) -> list[int]:
        path = [label]
        for t in range(upto, 0, -1):
            path.append(int(back[t][path[-1]]))
        return path[::-1]

    for e in parts:
        for now in e:
            both = score[:, None] + trans
            back.append(both.argmax(axis=0))
            score = both.max(axis=0) + now
        at = np.arange(len(trans))
        for t in range(len(back) - 1, 0, -1):
            at = back[t][at]
            if (at == at[0]).all():
                settled += follow(int(at[0]), t - 1)
                back = back[t:]
                break
    return np.array(settled + follow(int((score + trans[:, 0]).argmax()), len(back) - 1))


def field_spans(texts: pa.Array, field: Field) -> dict[int, list[tuple[str, int, int]]]:
    """By row, the byte spans that the field labels, before any check."""
    raw, off = buffer(texts)
    starts, ends, first = spans(raw, off, NOT_SPACE)
    mark = np.zeros(256, bool)
    mark[48:58] = mark[64] = True
    total = np.concatenate([[0], np.cumsum(mark[raw])])
    hot = np.flatnonzero(total[ends] > total[starts])
    if not len(hot):
        return {}
    row = np.searchsorted(first, hot, "right") - 1
    data = raw.tobytes()
    token = lambda i, r: data[starts[i] : ends[i]].decode("utf-8", "replace") if first[r] <= i < first[r + 1] else ""
    cut = np.flatnonzero(np.concatenate([[True], (hot[1:] != hot[:-1] + 1) | (row[1:] != row[:-1])]))
    by_length: dict[int, list[int]] = defaultdict(list)
    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(hot)]):
        by_length[e - s].append(s)
    memo: dict[tuple[str, str, str], np.ndarray] = {}
    out: dict[int, list[tuple[str, int, int]]] = defaultdict(list)

    def emissions(s: int, n: int) -> list[np.ndarray]:
        r = int(row[s])
        seen = [token(int(hot[s]) - 1 + k, r) for k in range(n + 2)]
        if len(memo) > 20_000:
            memo.clear()
        rows = []
        for k in range(n):
            three = tuple(seen[k : k + 3])
            if three not in memo:
                memo[three] = field.emissions(*three)
            rows.append(memo[three])
        return rows

    def told(s: int, labels: list[int]) -> None:
        k = 0
        while k < len(labels):
            if labels[k]:
                kind, to = LABELS[labels[k]][2:], k + 1
                while to < len(labels) and LABELS[labels[to]] == f"I-{kind}":
                    to += 1
                out[int(row[s])].append((kind, int(starts[hot[s + k]]), int(ends[hot[s + to - 1]])))
                k = to
            else:
                k += 1

    for length, runs in by_length.items():
        if length > RUN:
            for s in runs:
                parts = (emissions(s + a, min(RUN, length - a)) for a in range(0, length, RUN))
                told(s, viterbi_parts(parts, field.trans).tolist())
            continue
        per = max(1, 20_000 // length)
        for lo in range(0, len(runs), per):
            best = viterbi(np.array([emissions(s, length) for s in runs[lo : lo + per]]), field.trans)
            for s, labels in zip(runs[lo : lo + per], best.tolist()):
                told(s, labels)
    return out


_NEED = {"email": (0, 10**9), "ip": (4, 12), "card": (13, 19), "phone": (9, 15)}
_EDGE = re.compile(r"^[^0-9A-Za-z+(]+|[^0-9A-Za-z)]+$")


def find(texts: pa.Array, field: Field) -> list[tuple[list, list]]:
    """For each text (base spans, added spans) in code points; added ones have a plausible number of digits and overlap no base one."""
    added = field_spans(texts, field)
    _, off = buffer(texts)
    out = []
    for i, data in enumerate(texts.to_pylist()):
        text = data.decode("utf-8", "replace")
        base = base_spans(text)
        more = []
        if i in added:
            size = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            step = np.zeros(len(text) + 1, np.int64)
            for _, x, y in base:
                step[x] += 1
                step[y] -= 1
            taken = np.concatenate([[0], np.cumsum(np.cumsum(step) > 0)])  # code points of base spans before each place
            for kind, s, e in added[i]:
                s, e = int(size[s - off[i]]), int(size[e - off[i]])
                while s < e and not ("0" <= text[s] <= "9" or text[s].isalpha() or text[s] in "+("):
                    s += 1
                while e > s and not ("0" <= text[e - 1] <= "9" or text[e - 1].isalpha()):
                    e -= 1
                low, high = _NEED[kind]
                if s < e and low <= len(_digits(text[s:e])) <= high and (kind != "email" or "@" in text[s:e]) and taken[e] == taken[s]:
                    more.append((kind, s, e))
        out.append((sorted(base, key=_order), sorted(more, key=_order)))
    return out


def _order(span):
    return KINDS.index(span[0]), span[1]


def _told(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans (all), n_added.

    A null text is empty; a text without finds has the hash of the empty string and no
    spans; repeated rows are told alike; a null doc_id stays null; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    field = trained()

    def run(b):
        found = find(b.column(1), field)
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
        shas = [hashlib.sha256(_told(base).encode()).hexdigest() for base, _ in found]
        every = [_told(sorted(base + more, key=_order)) for base, more in found]
        return pa.record_batch([b.column(0), *counts, pa.array(shas), pa.array(every), pa.array([len(more) for _, more in found], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return map_texts(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with each found span replaced by its kind in brackets; all columns stay, n_chars follows a changed text.

    A null text stays null and an empty one empty; repeated rows are redacted alike;
    an empty table gives no rows; ids play no part.
    """
    rows = docs.select(*packed(docs, text_col))
    field = trained()

    def run(b):
        texts = pc.fill_null(b.column(1), b"")
        out = []
        for data, (base, more) in zip(texts.to_pylist(), find(texts, field)):
            every = sorted((s, e, k) for k, s, e in base + more)
            if not every:
                out.append(None)
                continue
            text, parts, at = data.decode("utf-8", "replace"), [], 0
            for s, e, k in every:
                if e > at:
                    parts += [text[at : max(s, at)], f"[{k.upper()}]" if s >= at else ""]
                    at = e
            out.append("".join([*parts, text[at:]]))
        changed = pa.array([x is not None for x in out])
        new = pc.coalesce(pa.array(out, pa.string()), b.column(1).cast(pa.string()))
        return pa.record_batch([b.column(0), new, changed], names=["row", "text", "changed"])

    done = map_texts(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, text string, changed boolean")
    return done.select(*unpacked(docs, text_col, F.col("text"), F.col("changed")))
