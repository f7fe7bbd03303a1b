"""Lexical retrieval: postings, BM25 per island, phrases."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.columns import tokens

K1, B = 1.2, 0.75


def _equal(word: str, t: Column) -> Column:
    return t == word


def postings(docs: DataFrame, scope: str, key: str, text: str) -> DataFrame:
    """(scope, key, term, tf); aggregated before the shuffle."""
    each = docs.select(scope, key, F.explode(tokens(text)).alias("term"))
    return each.groupBy(scope, key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, terms: list[str], scope: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(scope, key, score) of documents with any of the terms, statistics per scope.

    One pass over the documents: a document's length and its terms' frequencies are
    array expressions, so tokens are never exploded; only matching rows and one row
    of statistics per scope and term are shuffled.
    """
    terms = sorted(set(terms))
    toks = docs.select(scope, key, tokens(text).alias("_t"))
    counts = F.array(*(F.size(F.filter("_t", partial(_equal, w))) for w in terms))
    rows = toks.select(scope, key, F.when(F.col("_t").isNull(), 0).otherwise(F.size("_t")).alias("dl"), counts.alias("tfs"))
    stats = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col("tfs")[i] > 0).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col("tfs")[i], F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    hits = rows.where(F.exists("tfs", lambda x: x > 0))
    return hits.join(stats, scope).select(scope, key, F.round(score, 6).alias("score"))


def island_top(hits: DataFrame, scope: str, key: str, limit: int) -> DataFrame:
    """The best hits of each island, then of all: the literal limits reach the sort before the shuffle."""
    w = Window.partitionBy(scope).orderBy(F.desc("score"), key)
    best = hits.withColumn("island_rank", F.row_number().over(w)).where(F.col("island_rank") <= limit)
    return best.orderBy(F.desc("score"), key).limit(limit)


def phrase(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in which the words follow each other, and how often, without an index.

    Only texts that hold all words are taken apart. Their tokens are joined with two
    spaces, so that neighbouring phrases share none and their number is the number of
    replacements; words that can overlap with themselves are tried at each place.
    """
    low = F.lower(F.col(text))
    t = docs.where(reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in words))).select(key, tokens(text).alias("_t"))
    if any(words[:k] == words[-k:] for k in range(1, len(words))):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_t") - len(words) + 1, F.lit(1))), lambda i: F.slice("_t", i, len(words)) == F.array(*map(F.lit, words)))
        return t.where(F.array_contains("_t", words[0])).select(key, F.size(starts).cast("long").alias("n")).where("n > 0")
    needle = f" {'  '.join(words)} "
    joined = t.select(key, F.concat(F.lit(" "), F.array_join("_t", "  "), F.lit(" ")).alias("_x"))
    found = F.length("_x") - F.length(F.replace(F.col("_x"), F.lit(needle), F.lit("")))
    return joined.select(key, (found / len(needle)).cast("long").alias("n")).where("n > 0")
