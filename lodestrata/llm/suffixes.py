"""Removal of repeated byte strings by suffix arrays over shards that the strings' own content chooses.

Every WINDOW-byte string holds an anchor: of its GRAM-byte substrings the one with the
least hash, the first of equals. Equal strings have their anchor at the same place.
Neighbouring strings of one anchor are a run; a run's bytes are its context. A string
holds either the bytes before its anchor, half a string of them, or those from it on;
so a context falls into two pieces, and equal strings lie in pieces of equal halves.
Pieces whose half no other context has are done. The others go to the shard of their
half: a suffix array by Larsson-Sadakane refinement, common prefixes by Kasai's rule
along all pieces at once, and a string is repeated if a neighbour shares WINDOW bytes.
A half's pieces beyond SHARD bytes take several shards, merged by binary search of
one's strings in the others' arrays.

Contexts that are equal as a whole (128-bit hash) are copies: all their strings are
repeated, and one of them stands for all in the shards. A half with over HOT different
contexts, such as a passage in very many surroundings, is dealt anew by longer cores
of its strings, and what is left of those over HOT by the whole strings, which are
equal or not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import dropped, map_texts, packed, stored
from lodestrata.llm.textkernel import BLOCK, buffer, mix, powers

WINDOW = 400
GRAM = 32
SHARD = 1 << 20
HOT = 8_000
#: Strings whose anchors lie this near to each other in them share a core, for halves over HOT.
CORE = 24
_BLOCK = BLOCK - 1024


def anchor_runs(raw: np.ndarray, off: np.ndarray, window: int, gram: int):
    """Yields arrays (row, first start, starts, copies, anchor) of runs, part by part; starts and anchors are places in raw.

    copies: in a stretch with a period, where each run's context is that of the run
    before, the runs are told once with their number.
    """
    n = len(off) - 1
    row = 0
    while row < n:
        to = row + 1
        while to < n and off[to + 1] - off[row] <= _BLOCK:
            to += 1
        begin, end = int(off[row]), int(off[to])
        for lo in range(begin, max(begin + 1, end - window + 1), _BLOCK):  # a long text goes in parts
            hi = min(end, lo + _BLOCK + window - 1) if to == row + 1 else end
            if hi - lo >= window and (found := _runs(raw[lo:hi], off[row : to + 1] - lo, window, gram)):
                owner, start, many, copies, anchor = found
                yield row + owner, lo + start, many, copies, lo + anchor
            if to > row + 1:
                break
        row = to


def _runs(part, off, window, gram):
    p, inv = powers(len(part) + 1)
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    m = len(part) - gram + 1
    hashes = mix((total[gram:] - total[:m]) * inv[:m])
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | np.arange(m, dtype=np.uint64)
    width, span = 1, window - gram + 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least & low).astype(np.int32)  # of the string at each start
    starts = np.arange(len(anchor), dtype=np.int32)
    owner = (np.searchsorted(off, starts, "right") - 1).astype(np.int32)
    good = starts + window <= off[owner + 1]
    starts, owner, anchor = starts[good], owner[good], anchor[good]
    if not len(starts):
        return None
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    many = np.diff(np.concatenate([new, [len(starts)]]))
    owner, start, anchor = owner[new].astype(np.int64), starts[new].astype(np.int64), anchor[new].astype(np.int64)
    copies = np.ones(len(new), np.int64)
    again = np.concatenate([[False], (owner[1:] == owner[:-1]) & (hashes[anchor[1:]] == hashes[anchor[:-1]]) & (many[1:] == many[:-1]) & (np.diff(anchor) == many[1:])])
    keep = np.ones(len(new), bool)
    edge = np.flatnonzero(np.diff(np.concatenate([again.view(np.int8), [0]])))
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):  # runs i to j follow each other at one distance
        stretch = part[start[i] : start[j] + many[j] - 1 + window]
        if np.array_equal(stretch[many[i] :], stretch[: -many[i]]):
            copies[i] = j - i + 1
            keep[i + 1 : j + 1] = False
    return owner[keep], start[keep], many[keep], copies[keep], anchor[keep]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text ordered by their first `depth` bytes or more, by refining groups of equal prefixes, each round of twice the length."""
    n = len(text)
    rank_of = lambda key: np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    key = words(text)
    order = np.argsort(key, kind="stable")
    heads = rank_of(key[order])
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(heads, np.diff(np.concatenate([heads, [n]])))
    h = 8
    while h < depth:
        sizes = np.diff(np.concatenate([heads, [n]]))
        open_ = heads[sizes > 1]
        if not len(open_):
            break
        many = sizes[sizes > 1]
        at = np.repeat(open_, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = order[at]  # only groups that aren't single are sorted again
        key = (rank[place] + 1) << 32 | (rank[np.minimum(place + h, n)] + 1)
        again = np.argsort(key, kind="stable")
        place, key = place[again], key[again]
        order[at] = place
        inner = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.sort(np.concatenate([heads[sizes == 1], at[inner]]))
        first = at[inner]
        rank[place] = np.repeat(first, np.diff(np.concatenate([np.flatnonzero(inner), [len(at)]])))
        h *= 2
    return order


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a big-endian number; past the end are zeros."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(text)] << np.uint64(8 * (7 - k))
    return out


def neighbour_prefixes(text: np.ndarray, order: np.ndarray, begin: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """For each place in order the bytes it shares with the one before, `most` at most.

    Kasai's rule: a place's common prefix is at most one byte shorter than its left
    neighbour's in the text, where the place after that one's predecessor comes before
    it in order too. It is followed along all stretches begin..begin+count at once;
    order holds just these places.
    """
    eight = words(text)
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.full(len(text) + 1, len(text), np.int64)
    place[order] = np.arange(len(order))
    shared = np.zeros(len(text), np.int64)
    longest = np.argsort(-count, kind="stable")
    begin, count = begin[longest], count[longest]
    k, was = np.zeros(len(begin), np.int64), np.full(len(begin), -1)
    for step in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -step, "left"))
        p = begin[:live] + step
        q = before[p]
        now = np.maximum(k[:live] - 1, 0)
        now[(q < 0) | (was[:live] < 0) | (place[was[:live] + 1] >= place[p])] = 0
        was[:live] = q
        go = np.flatnonzero((q >= 0) & (now < most))
        while len(go):
            diff = eight[p[go] + now[go]] ^ eight[q[go] + now[go]]
            same = diff == 0
            part = go[~same]
            if len(part):
                d, gain, ok = diff[~same], np.zeros(len(part), np.int64), np.ones(len(part), bool)
                for b in range(7):
                    ok &= (d >> np.uint64(56 - 8 * b)) & np.uint64(255) == 0
                    gain += ok
                now[part] += gain
            go = go[same]
            now[go] += 8
            go = go[now[go] < most]
        k[:live] = np.minimum(now, most)
        shared[p] = k[:live]
    return shared[order]


def found_in(text: np.ndarray, order: np.ndarray, other: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Whether the `width` bytes of other at each of places occur at one of order's places of text, by binary search."""
    a, b = words(text), words(other)

    def less(at, place):  # is text[at:] below other[place:] in the first bytes, and are these equal
        out, equal, left = np.zeros(len(at), bool), np.ones(len(at), bool), np.arange(len(at))
        for k in range(0, width, 8):
            x, y = a[at[left] + k], b[place[left] + k]
            if width - k < 8:
                cut = np.uint64(8 * (8 - (width - k)))
                x, y = x >> cut, y >> cut
            differ = x != y
            out[left[differ]] = x[differ] < y[differ]
            equal[left[differ]] = False
            left = left[~differ]
            if not len(left):
                break
        return out, equal

    lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(order))
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) // 2
        below, _ = less(order[mid], places[open_])
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    inside = lo < len(order)
    out = np.zeros(len(places), bool)
    out[inside] = less(order[lo[inside]], places[inside])[1]
    return out


class Shard:
    """The suffix array of some contexts' strings."""

    def __init__(self, contexts: list[bytes], window: int):
        self.text = np.frombuffer(b"".join(contexts), np.uint8)
        size = np.array([len(c) for c in contexts])
        self.begin = np.cumsum(size) - size
        self.count = size - window + 1
        valid = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(valid, self.begin, 1)
        np.add.at(valid, self.begin + self.count, -1)
        valid = np.cumsum(valid[:-1]) > 0
        order = suffix_array(self.text, window)
        self.order = order[valid[order]]
        near = neighbour_prefixes(self.text, self.order, self.begin, self.count, window) >= window
        self.repeated = np.zeros(len(self.text), bool)
        self.repeated[self.order[near]] = True
        self.repeated[self.order[np.flatnonzero(near) - 1]] = True
        self.valid = valid
        self.window = window

    def merge(self, other: Shard) -> None:
        for a, b in ((self, other), (other, self)):
            places = np.flatnonzero(b.valid & ~b.repeated)
            b.repeated[places[found_in(a.text, a.order, b.text, places, self.window)]] = True

    def spans(self):
        """(context, first, last) of each run of repeated strings."""
        for i, (s, n) in enumerate(zip(self.begin.tolist(), self.count.tolist())):
            own = self.repeated[s : s + n]
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    yield i, a, b - 1


_SPAN = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_PIECE = "key long, single boolean, t1 long, t2 long, s long, o int, text binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _sharded(window: int, shard: int):
    """(t1, t2, a, b): bytes to remove, from pieces (key, single, t1, t2, s, text) sorted by key."""

    def solve(groups):
        """groups: lists of pieces with whole keys, or one key in several lists."""
        shards = [Shard([c[5] for c in g], window) for g in groups]
        for i, x in enumerate(shards):
            for y in shards[:i]:
                x.merge(y)
        out = []
        for x, g in zip(shards, groups):
            out += [(g[i][2], g[i][3], g[i][4] + a, g[i][4] + b + window) for i, a, b in x.spans() if g[i][1]]
        if out:
            yield _batch(out, _SPAN)

    def run(batches):
        def keys():
            held, size = [], 0
            for b in batches:
                for c in zip(*(x.to_pylist() for x in b.columns)):
                    if held and c[0] != held[-1][0]:
                        yield held, size
                        held, size = [], 0
                    held.append(c)
                    size += len(c[5])
            if held:
                yield held, size

        group, total = [], 0
        for held, size in keys():
            if size > shard:
                parts, room = [[]], 0
                for c in held:
                    if room > shard:
                        parts.append([])
                        room = 0
                    parts[-1].append(c)
                    room += len(c[5])
                yield from solve(parts)
                continue
            group += held
            total += size
            if total > shard:
                yield from solve([group])
                group, total = [], 0
        if group:
            yield from solve([group])

    return run


def _cores(window: int, width: int, texts: bool):
    """Pieces again, of strings whose anchors lie within `width` bytes of each other: the key is that of what these strings share."""
    names = [x.split()[0] for x in _PIECE.split(", ")][: None if texts else 1]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()][: len(names)]
    schema = pa.schema(list(zip(names, types)))

    def run(b):
        out = []
        for single, t1, t2, s, o, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names_in)):
            least = o - (len(text) - window)  # of the piece's anchor offsets, the first string has the greatest
            for q in range(least // width, o // width + 1):
                low, high = q * width, q * width + width - 1
                key = xxhash.xxh3_64_intdigest(text[o - low : o + window - high], q + 3) - (1 << 63)
                if texts:
                    top = min(o, high)
                    out.append((key, single, t1, t2, s + o - top, top, text[o - top : o - max(least, low) + window]))
                else:
                    out.append((key,))
            if len(out) > 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    names_in = ["single", "t1", "t2", "s", "o", "text"]
    return run


def _strings(window: int):
    """Each string of pieces by its 128-bit hash."""
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("single", pa.bool_()), ("t1", pa.int64()), ("t2", pa.int64()), ("a", pa.int64())])

    def run(b):
        for single, t1, t2, s, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("single", "t1", "t2", "s", "text"))):
            n = len(text) - window + 1
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[k : k + window]) for k in range(n)), np.int64).reshape(n, 2)
            yield pa.record_batch([pa.array(d[:, 0]), pa.array(d[:, 1]), *(pa.array([x] * n, t) for x, t in ((single, pa.bool_()), (t1, pa.int64()), (t2, pa.int64()))), pa.array(np.arange(s, s + n))], schema=schema)

    return run


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(t1, t2, cuts) over texts (t1, t2, text): for each text's hashes with bytes to remove their ranges, as structs a, b; they may overlap."""
    half = (window - gram) // 2

    def runs_of(b):
        t = [b.column(i).to_numpy() for i in (0, 1)]
        raw, off = buffer(b.column(2))
        data = raw.tobytes()
        digest, short = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
        for row, start, many, copies, anchor in anchor_runs(raw, off, window, gram):
            whole, before, after = [], [], []
            for s, n, a in zip(start.tolist(), many.tolist(), anchor.tolist()):
                whole.append(digest(data[s : s + n - 1 + window]))
                # a string holds the `half` bytes before its anchor, or the window - half bytes from it on
                before.append(short(data[a - half : a + gram], 1) - (1 << 63) if a - s >= half else None)
                after.append(short(data[a : a + window - half], 2) - (1 << 63) if a - (s + n - 1) < half else None)
            c = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(x) for x in (t[0][row], t[1][row], start - off[row], many.astype(np.int32), copies.astype(np.int32), (anchor - start).astype(np.int32), c[:, 0], c[:, 1])] + [pa.array(before, pa.int64()), pa.array(after, pa.int64())],
                names=["t1", "t2", "s", "n", "copies", "o", "c1", "c2", "before", "after"],
            )

    runs = stored(map_texts(texts, runs_of, "t1 long, t2 long, s long, n int, copies int, o int, c1 long, c2 long, before long, after long"), "anchor-runs")
    kinds = runs.groupBy("c1", "c2").agg(F.sum("copies").alias("total"), *(F.first(c).alias(c) for c in ("t1", "t2", "s", "n", "o", "before", "after")))
    kinds = stored(kinds, "contexts")
    whole = runs.join(kinds.where("total > 1").select("c1", "c2"), ["c1", "c2"], "left_semi")
    whole = stored(whole.select("t1", "t2", F.col("s").alias("a"), (F.col("s") + F.col("n").cast("long") * F.col("copies") - 1 + window).alias("b")), "whole-contexts")
    dropped(runs)

    sides = F.filter(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("key")), F.struct(F.lit(1).alias("side"), F.col("after").alias("key"))), lambda x: x["key"].isNotNull())
    halves = kinds.select((F.col("total") == 1).alias("single"), "t1", "t2", "s", "n", "o", F.explode(sides).alias("x")).select("single", "t1", "t2", "s", "n", "o", "x.*")
    shared = halves.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    near = stored(halves.join(shared, "key"), "near-pieces")
    dropped(kinds)
    wanted = near.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "k", "single", "side", "s", "n", "o")).alias("want"))
    piece = pa.schema([("key", pa.int64()), ("k", pa.int64()), ("single", pa.bool_()), ("t1", pa.int64()), ("t2", pa.int64()), ("s", pa.int64()), ("o", pa.int32()), ("text", pa.binary())])

    def cut_out(b):
        for t1, t2, text, want in zip(*(c.to_pylist() for c in b.columns)):
            out = []
            for w in want:
                s, o, last = w["s"], w["o"], w["s"] + w["n"] - 1
                if w["side"]:
                    s, o = max(s, s + o - half + 1), min(o, half - 1)
                else:
                    last = min(last, s + o - half)
                out.append((w["key"], w["k"], w["single"], t1, t2, s, o, text[s : last + window]))
            yield _batch(out, piece)

    once = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))  # of copies one
    pieces = map_texts(once.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "want"), cut_out, _PIECE.replace("key long", "key long, k long"))
    pieces = stored(pieces, "pieces")
    dropped(near)
    columns = ["key", "single", "t1", "t2", "s", "o", "text"]
    crowded = pieces.where(F.col("k") > hot).select(columns)
    cores = map_texts(crowded, _cores(window, CORE, False), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    cores = stored(map_texts(crowded, _cores(window, CORE, True), _PIECE).join(cores, "key"), "cores")
    few = pieces.where(F.col("k") <= hot).select(columns).unionByName(cores.where(F.col("k") <= hot).select(columns)).drop("o")
    parts = few.repartition("key").sortWithinPartitions("key").mapInArrow(_sharded(window, shard), "t1 long, t2 long, a long, b long")
    many = map_texts(cores.where(F.col("k") > hot), _strings(window), "d1 long, d2 long, single boolean, t1 long, t2 long, a long")
    twice = many.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2")
    hit = many.where("single").join(twice, ["d1", "d2"], "left_semi").select("t1", "t2", "a", (F.col("a") + window).alias("b"))
    return whole.unionByName(parts).unionByName(hit).distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))


def dedup_strings(docs: DataFrame, window: int = WINDOW, text_col: str = "text", **settings) -> DataFrame:
    """Per document: row (a struct of its other columns), n_bytes, n_removed, n_spans, kept (what is left of the UTF-8 bytes).

    Every byte goes that a string of `window` bytes covers which also starts anywhere
    else, in the same document or another; the first copy goes too. A null text is
    empty; texts below the window keep all; repeated rows are copies of each other;
    an empty table gives no rows; ids play no part.
    """
    rows = docs.select(*packed(docs, text_col)).withColumn("text", F.coalesce("text", F.lit("").cast("binary")))
    hashed = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(window), "text").alias("t2")]
    spans = repeated_spans(rows.where(F.length("text") >= window).select(*hashed, "text"), window, **settings)
    rows = rows.select("row", "text", *hashed).join(stored(spans, "cuts"), ["t1", "t2"], "left").select("row", "text", "cuts")

    def run(b):
        sizes, left = [], []
        for text, cuts in zip(b.column(1).to_pylist(), b.column(2)):
            gone = spans = at = 0
            parts = []
            for s, e in sorted((c["a"], c["b"]) for c in cuts.as_py() or ()):
                if s > at or not spans:
                    parts.append(text[at:s])
                    spans += 1
                    gone += e - s
                    at = e
                elif e > at:
                    gone += e - at
                    at = e
            sizes.append((len(text), gone, spans))
            left.append(b"".join([*parts, text[at:]]))
        return pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*sizes)), pa.array(left, pa.binary())], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_texts(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def string_report(docs: DataFrame, window: int = WINDOW, **settings) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; rows and texts as in dedup_strings()."""
    found = dedup_strings(docs.select("doc_id", "text"), window, **settings)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
