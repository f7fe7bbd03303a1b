"""Which documents contain which passages, without comparing every document with every passage."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of passages in one broadcast.
MAX_BYTES = 32 << 20
GRAM = 16


@lru_cache(2)
def _automaton(parts: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in parts:
        found.add_word(p, p)
    found.make_automaton()
    return found


def _scanned(docs: DataFrame, parts: tuple[str, ...], key: str) -> DataFrame:
    """(key, part) of the broadcast parts that a document's text contains: one walk over the text."""
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        find = _automaton(sent.value)
        for b in batches:
            ids, hits = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                got = {p for _, p in find.iter(text)} if text else ()
                ids += [i] * len(got)
                hits += sorted(got)
            yield pa.record_batch([b.column(0).take(pa.array(ids, pa.int64())), pa.array(hits, pa.string())], names=[key, "part"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col("text").cast("string")).mapInArrow(run, f"`{key}` {kind}, part string")


def containing(docs: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, part), each once, of the documents that contain a part of (part); empty parts are in none.

    Parts within MAX_BYTES, whose size is checked, are an Aho-Corasick automaton that
    every task walks with its texts. Beyond that those of GRAM characters or more meet
    the documents by their first GRAM characters in a shuffled join and are then
    verified, and the shorter ones take as many automata as they need.
    """
    parts = passages.where("part <> ''").select("part").distinct()
    small = (parts.agg(F.sum(F.octet_length("part"))).first()[0] or 0) <= MAX_BYTES
    short = parts if small else parts.where(F.length("part") < GRAM)
    out = None
    if not small:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - GRAM + 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(GRAM)))
        heads = parts.where(F.length("part") >= GRAM).withColumn("_head", F.substring("part", 1, GRAM))
        met = docs.select(key, "text").withColumn("_head", F.explode(F.array_distinct(grams))).join(heads, "_head")
        out = met.where(F.contains("text", F.col("part"))).select(key, "part")
    chunks = max(1, -(-(short.agg(F.sum(F.octet_length("part"))).first()[0] or 0) // MAX_BYTES))
    for c in range(chunks):
        mine = short.where(F.pmod(F.xxhash64("part"), F.lit(chunks)) == c)
        got = _scanned(docs, tuple(sorted(r[0] for r in mine.collect())), key)  # MAX_BYTES, about
        out = got if out is None else out.unionByName(got)
    return out
